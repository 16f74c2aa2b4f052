"""URL rules, media columns, personal data, toxicity: odd rows, brute force, exact round trips."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vouch.llm import media, pii, toxicity, url_rules

# --- URL rules ---

URLS = [None, "", "no scheme", "http://", "http://x.org", "http://x.org/", "HTTP://EXAMPLE.ORG/es/1",
        "https://a.b.example.org/en/12?q=/es/#/x", "https://example.org/en/1", "https://example.org/en",
        "https://notexample.org/es/", "http://.org/", "http://org/", "http://org./", "http://x.com/fr/",
        "http://x.com/fr", "http://x.com/de/a/b", "http://com/de/", "http://x.net/de/", "x://y.com?/fr/",
        "a://b://c.com/fr/", "http://x.com:80/fr/", "http://u@x.com/fr/a", "http://ÄX.com/fr/",
        "http://x.org#/es/", "http://x.com//fr/", "http://ex\nample.org/es/\nx"]


def judged(url, rules=url_rules.RULES, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(h), len(p), verdict == "block", rule, verdict))
    best = max(fits)[3:] if fits else (None, default)
    return (host, path, *best)


def test_url_rules(spark):
    rows = [(i if i % 5 else None, u, "x") for i, u in enumerate(URLS)] + [(1, URLS[6], "x")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_rules.judge(df, keep=["page_id"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((p, *judged(u)) for p, u, _ in rows), key=repr)
    assert url_rules.judge(df).columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert url_rules.judge(df.where("false"), keep=["page_id"]).count() == 0


def test_random_rules():
    rng = random.Random(3)
    for _ in range(300):
        rules = tuple((rng.choice(["allow", "block"]), ".".join(rng.choice("ab") for _ in range(
            rng.randint(1, 3))) + "/" + rng.choice(["", "x", "x/", "x/y", "x/y/", "xy", "/"]))
            for _ in range(rng.randint(1, 6)))
        trie = url_rules.RuleTrie(rules)
        for _ in range(10):
            url = "h://" + ".".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + "".join(
                rng.choice(["/x", "/xy", "/", "/y", "x"]) for _ in range(rng.randint(0, 3)))
            host, path = url_rules.host_and_path(url)
            assert (trie.match(host, path) or (None, "allow")) == judged(url, rules)[2:]
    with pytest.raises(ValueError):
        url_rules.RuleTrie((("maybe", "a/"),))


# --- media columns ---

@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 2048, 2049, 64 * 32 * 3, 300_000])
def test_media_round_trip(size):
    raw = random.Random(size).randbytes(size)
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload[:size] == raw and not any(payload[size:])
    file = media.write_media(payload)
    (track,) = media.read_tracks(file)
    assert media.read_payload(file, track) == payload
    assert (track.codec, track.duration, len(track.sizes)) == ("raw ", len(payload), len(payload) // 64)
    keys = track.keyframes()
    for k, (a, b) in enumerate(keys.tolist()):
        assert file[a:b] == payload[k * 16 * 64:k * 16 * 64 + 64]
    assert len(keys) == -(-len(track.sizes) // 16)


def test_walk_of_broken_and_large_boxes():
    payload = media.padded(b"abc" * 500)
    file = media.write_media(payload)
    kinds = [p[-1] for p, _, _ in media.walk(file)]
    assert kinds[0] == b"ftyp" and {b"stsz", b"stco", b"stss", b"mdat"} <= set(kinds)
    for cutoff in range(0, len(file), 97):  # any cut-off file is read without an error
        for path, a, b in media.walk(file[:cutoff]):
            assert a <= b <= cutoff and path
    wide = struct.pack(">I4sQ", 1, b"free", 24) + bytes(8)
    assert [(p, b - a) for p, a, b in media.walk(wide)] == [((b"free",), 8)]
    assert [p for p, _, _ in media.walk(struct.pack(">I4s", 0, b"mdat") + b"xx")] == [(b"mdat",)]
    assert media.read_tracks(b"") == []
    several = [(1, 2), (3, 1)]  # chunks of unlike size, samples of unlike size
    stsc = struct.pack(">I", 0) + struct.pack(">I", 2) + b"".join(
        struct.pack(">III", a, n, 1) for a, n in several)
    stsz = struct.pack(">III", 0, 0, 5) + struct.pack(">5I", 3, 4, 5, 6, 7)
    stco = struct.pack(">II", 0, 3) + struct.pack(">3I", 100, 200, 300)
    data, at = b"", {}
    for name, table in ((b"stsc", stsc), (b"stsz", stsz), (b"stco", stco)):
        at[name] = (len(data), len(data) + len(table))
        data += table
    offsets, sizes = media._placed(at, data)
    assert offsets.tolist() == [100, 103, 200, 205, 300] and sizes.tolist() == [3, 4, 5, 6, 7]


def test_media_columns(spark):
    rows = [(1, None), (2, ""), (None, "é ß 😀"), (3, "x" * 70_000), (3, "x" * 70_000), (4, "é ß 😀")]
    df = spark.createDataFrame([(a, b, "f") for a, b in rows], "doc_id long, text string, feature string")
    got = media.media_features(df, keep=["doc_id"], with_file=True).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = {(t or "").encode() for d, t in rows if d == r.doc_id}
        raw = next(t for t in texts if len(t) == r.n_bytes)
        payload = media.padded(raw)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.payload_bytes == len(payload)
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert len(r.ranges) == r.keyframes and "codec=raw" in r.feature
    by_text = {}
    for r in got:
        by_text.setdefault(r.payload_sha256, set()).add((r.feature, r.media_sha256))
    assert all(len(v) == 1 for v in by_text.values())
    assert media.media_features(df).columns[:1] == ["doc_id"]
    assert media.media_features(df.where("false")).count() == 0


# --- personal data ---

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_patterns():
    rng = random.Random(6)
    parts = ["a@b.c", "a@b", "@", "x.y+z@d-e.f.g", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "010.1.1.1",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "+1 (555) 555-1234", "+12", "+",
             "++49 30 1234567", " ", ".", "é", "0", "99", "a@b.c@d.e", "-", "@@", "b.c", "%@x.y"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 7)))
        assert pii.base_spans(text) == plain_spans(text), text
    for long in ("a" * 200_000, "1" * 200_000, "1 " * 100_000, "+1" + " " * 200_000, "@" * 100_000,
                 "a@" * 100_000, "1." * 100_000):
        pii.base_spans(long)  # in linear time


@pytest.fixture(scope="module")
def chain():
    return pii.train()


def test_chain_decoding(chain):
    rng = np.random.default_rng(2)
    from itertools import product

    for n in (1, 2, 3, 4):
        e = rng.normal(size=(n, pii.S)) * 2
        moves = chain.moves + pii.ALLOWED
        best = max(product(range(pii.S), repeat=n), key=lambda y: pii.FIRST[y[0]] + sum(
            e[t, y[t]] for t in range(n)) + sum(moves[y[t], y[t + 1]] for t in range(n - 1)))
        (path,) = pii.viterbi(chain, [e])
        assert tuple(path) == best
    many = [rng.normal(size=(n, pii.S)) for n in (0, 5, 1, 9, 5, 3)]
    for e, path in zip(many, pii.viterbi(chain, many)):
        assert np.array_equal(path, pii.viterbi(chain, [e])[0])


def test_chain_finds_what_patterns_miss(chain):
    texts = ["please call me at (646) 555-0177 tonight", "write to tom.b [at] office.example.net now",
             "ring +1 (442) 555-2960 4524132264652876 and go", "version 2.11.0 came on 2019-04-02",
             "no numbers here", "", "0171 555 0148"]
    found = [pii.joined(s) for _, s in pii.find(chain, texts)]
    assert found[0] == "phone:18:32" and found[1].startswith("email:9:")
    assert "phone:5:22" in found[2] and found[3:6] == ["", "", ""]
    text = "a " + "x1 " * 3000 + "call (646) 555-0177 now"
    assert any(k == 3 for _, k, _ in pii.find(chain, [text])[0][1])


def test_personal_data_rows(spark, chain):
    rows = [(1, None), (2, ""), (None, "é a@b.c 😀 1.2.3.4"), (3, "4111 1111 1111 1111 " * 3), (3, "no")] * 2
    df = spark.createDataFrame([(a, b, 7, "s") for a, b in rows],
                               "doc_id long, text string, n_chars long, spans string")
    got = pii.personal_data(df, keep=["doc_id"]).collect()
    want = []
    for d, t in rows:
        base = plain_spans(t or "")
        text = ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in base)
        want.append((d, *(sum(s[1] == k for s in base) for k in range(4)),
                     hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    clean = pii.redact(df).collect()
    assert clean[0].asDict().keys() == set(df.columns) and df.columns == list(clean[0].asDict())
    assert {r.text for r in clean if r.doc_id is None} == {"é <EMAIL> 😀 <IP>"}
    assert all((r.text is None and r.n_chars is None) or r.n_chars == len(r.text) for r in clean)
    assert pii.redact(df.where("false")).count() == 0


# --- toxicity ---

def labelled(spark, n=400):
    rng = random.Random(8)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
             for _ in range(500)]
    rows, labels = [], []
    for i in range(n):
        parts, bad = [rng.choice(words) for _ in range(rng.randint(3, 80))], rng.random() < 0.3
        if bad:
            for _ in range(3):
                parts.insert(rng.randrange(len(parts) + 1), "zonk" + rng.choice(["er", "ing", "y,"]))
        rows.append((i, " ".join(parts), rng.choice(["en", "de"])))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out_and_odd_rows(spark):
    rows, labels = labelled(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([*labels, (None, 1), (9999, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    odd = spark.createDataFrame([(1, None, None, 5.0), (2, "", "en", 5.0), (None, "ok", "xx", 5.0),
                                 (7, "word " * 50_000, "de", 5.0), (8, "ZONKER", "en", 5.0)] * 2,
                                "doc_id long, text string, lang string, score double")
    got = toxicity.score(odd, model, keep=["doc_id"]).collect()
    assert len(got) == 10 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = toxicity.score(docs, model).join(marks, "doc_id").where(
        toxicity.in_fold(F.col("doc_id"), 5, 0)).collect()
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    assert toxicity.score(odd.where("false"), model, keep=["doc_id"]).count() == 0
    # the language moves no score
    other = toxicity.score(docs.withColumn("lang", F.lit("fr")), model).select("doc_id", "score")
    assert sorted(other.collect()) == sorted(toxicity.score(docs, model).select("doc_id", "score").collect())


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).first().predicted == 0


def test_batching_does_not_change_a_score(spark):
    rows, _ = labelled(spark, 40)
    rng = np.random.default_rng(1)
    model = toxicity.constant(0.3)
    model.table[:] = rng.normal(size=model.table.shape)
    for w in model.filters:
        w[:] = rng.normal(size=w.shape)
    model.out[:] = rng.normal(size=model.out.shape)
    texts = [t for _, t, _ in rows] + ["", "one"]
    together = model.score(*toxicity.keys_of(pa.array(texts)))
    alone = [model.score(*toxicity.keys_of(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone)


def test_threshold_parts_the_classes():
    assert toxicity.threshold(np.array([0.1, 0.2, 0.7, 0.9]), np.array([0, 0, 1, 1])) == pytest.approx(0.45)
    assert toxicity.threshold(np.array([0.1, 0.2]), np.array([0, 0])) == 0.5


def test_a_chosen_id_over_many_rows_is_trained_on_once(spark):
    texts = [(i, f"good words number {i}" if i % 2 else f"bad zonk number {i}", "en") for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    few = [r for r in texts if r[0] in (7, 8, 9)]
    again = spark.createDataFrame(few * 200, docs.schema)
    model = toxicity.fit(docs, marks, None)
    repeated = toxicity.fit(docs.unionByName(again), marks, None)
    assert (model.table == repeated.table).all() and model.bias == repeated.bias
    assert model.thresholds == repeated.thresholds


def test_every_labelled_row_is_learned_from(spark, monkeypatch):
    # rows of many blocks, in any partitions; each row moves the model
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 16)
    rows, labels = labelled(spark, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, None)
    shuffled = toxicity.fit(docs.repartition(7, "text"), marks.repartition(5), None)
    assert (model.numbers() == shuffled.numbers()).all() and model.thresholds == shuffled.thresholds
    kept = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0).collect()}
    for i in [i for i in range(120) if i not in kept][:3]:
        without = toxicity.fit(docs, marks.where(F.col("doc_id") != i), None)
        assert (without.numbers() != model.numbers()).any()


def test_training_rows_hold_keys_not_texts(spark):
    """The rounds read the same word keys as the texts give, in less room than the texts."""
    texts = ["", None, "one", "Two, two  THREE\n", "the quick brown fox jumps " * 50]
    rows = spark.createDataFrame([(k % 2, k, 1, False, "en", t) for k, t in enumerate(texts)],
                                 "_block long, doc_id long, _toxic int, _back boolean, lang string, text string")
    out = toxicity._keyed(rows).orderBy("doc_id").toArrow()
    assert "text" not in out.column_names
    keys, counts = toxicity._unpacked(out.column("keys").combine_chunks().slice(1))
    want, numbers = toxicity.keys_of(pa.array([t or "" for t in texts[1:]]))
    assert np.array_equal(keys, want) and counts.tolist() == numbers.tolist()
    assert out.column("keys").nbytes < 0.9 * sum(len((t or "").encode()) for t in texts)
