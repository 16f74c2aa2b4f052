"""The pipeline against the same steps in plain Python."""

import hashlib
import random

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_near_copies import brute_classes
from vouch.llm import mixing, pieces, pii, toxicity


def fixture(spark, folder):
    rng = random.Random(11)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
             for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    rows, labels = [], []
    for i in range(260):
        text, toxic = prose(rng.randint(20, 90)), rng.random() < 0.25
        if toxic:
            parts = text.split()
            for _ in range(4):
                parts.insert(rng.randrange(len(parts)), rng.choice(["zonkidiot", "zonkfool"]))
            text = " ".join(parts)
        if i % 9 == 0:
            text += f" mail a{i}@mail.example.com or +1 (555) 555-{1000 + i} " + prose(5)
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]),
                     len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(300 + i, rows[i][1], *rows[i][2:]) for i in range(0, 60, 2)]  # copies
    rows += [(400 + i, rows[i][1] + " end", *rows[i][2:]) for i in range(1, 60, 2)]
    rows += [(500, None, "en", "a", None), (501, "", "en", "c", 0), (502, "", None, "c", 0),
             (None, prose(30), "de", "b", 9), (503, "same row", "en", "b", 8), (503, "same row", "en", "b", 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    return rows, labels


def brute_mix(rows):
    """Copies of each row by prefix sums over sorted rows, in whole numbers."""
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len((r[1] or "").split()) for r in rows if r[3] == s) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, [s for s in names if size[s]], 1.5 * sum(size.values())
    target = {s: 0.0 for s in names}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * size[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.remove(s)
    taken = {}
    for s in names:
        name = f"42:{s if s is not None else chr(0) + 'null'}"
        offset = int(hashlib.md5(name.encode()).hexdigest()[:7], 16) * 8
        each = round(target[s] / size[s] * 2 ** 31) if size[s] else 0
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (
            len((r[1] or "").split()), r[0] is not None, r[0] or 0))
        taken[s] = [(offset + (k + 1) * each) // 2 ** 31 - (offset + k * each) // 2 ** 31
                    for k in range(len(own))]
        yield s, target[s], size[s], list(zip(own, taken[s]))


def test_pipeline_against_plain_python(spark, tmp_path):
    folder = str(tmp_path)
    rows, _ = fixture(spark, folder)
    out = corpus_pipeline.run(spark, folder).collect()

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    score = model.score(*toxicity.keys_of(pa.array([r[1] or "" for r in rows])))
    left = [r for r, s in zip(rows, score)
            if s < model.thresholds.get(r[2] or "", model.thresholds[None])]
    assert 0 < len(rows) - len(left) < 130
    assert sum("zonk" in (r[1] or "") for r in left) < 10

    roots = brute_classes([r[1] for r in left])
    first = {}
    for r, root in zip(left, roots):
        key = (r[0] is None, r[0] or 0)
        if root not in first or key < first[root][0]:
            first[root] = (key, r)
    unique = [r for _, r in first.values()]

    chain = pii.train()
    clean = []
    for (d, text, lang, source, _), (_, spans) in zip(unique, pii.find(
            chain, [r[1] or "" for r in unique])):
        text = None if text is None else pii.redacted(text, spans)
        clean.append((d, text, lang, source, None if text is None else len(text)))
    assert any("<EMAIL>" in (r[1] or "") for r in clean)

    want = [r for _, _, _, placed in brute_mix(clean) for r, n in placed for _ in range(n)]
    got = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    vocabulary = pieces.Pieces.load(pieces.default_model())
    for r in out:
        edges = vocabulary.segment(" " + r.text) if r.text else []
        assert r.ids == vocabulary.ids(edges).tolist() and r.round_trip


def test_mixing_targets_and_copies(spark, tmp_path):
    rows, _ = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("extra", F.lit(1))
    got = mixing.taken(docs).collect()
    for source, target, size, placed in brute_mix(rows):
        own = [r for r in got if r.source == source]
        assert all(r.source_size == size and abs(r.target - target) < 1e-6 for r in own)
        assert sorted(repr((r.doc_id, r.taken)) for r in own) == sorted(
            repr((r[0], n * len((r[1] or "").split()))) for r, n in placed)
        longest = max(r.size for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 2 * longest
        assert all(r.taken <= 2 * r.size for r in own)
    assert mixing.taken(docs.where("false")).count() == 0
    assert mixing.mix(docs.where("false")).count() == 0


def test_stages_keep_clashing_columns_and_empty_tables(spark, tmp_path):
    rows, labels = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clash = docs.select("*", *[F.lit(n).alias(n) for n in (
        "score", "flagged", "spans", "redacted", "fp", "root", "size", "copies", "held_out", "_row1",
        "_row2", "_id", "_k", "_text", "_copies", "_before", "each", "n", "k_text", "node", "grp", "s0", "label", "a")])
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, clash, str(tmp_path))
        assert out.columns[:len(clash.columns)] == clash.columns
        row = out.first()
        assert row["score"] == "score" and row["fp"] == "fp" and row["size"] == "size"
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
