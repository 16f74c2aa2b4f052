"""Token alignment against a plain walk over whole texts, each encoded by the libraries at once."""

import hashlib
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vouch.llm import alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.default_models())


def plain(text, pair):
    """(A ids, B ids, links, cuts) by a loop over all token pairs of the whole text."""
    if not text:
        return [], [], [], []
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    raw = (" " + text).encode()
    if any(b"".join(of[i] for i in ids) != raw for ids, of in ((a, pair.a_bytes), (b, pair.b_bytes))):
        return [], [], [], []
    ends = [np.cumsum([len(of[i]) for i in ids]).tolist()
            for ids, of in ((a, pair.a_bytes), (b, pair.b_bytes))]
    begins = [[0, *e[:-1]] for e in ends]
    links = [(i, j) for i in range(len(a)) for j in range(len(b))
             if begins[0][i] < ends[1][j] and begins[1][j] < ends[0][i]]
    cuts = [(ends[0].index(e) + 1, ends[1].index(e) + 1) for e in ends[0] if e in ends[1]]
    return a, b, links, cuts


def plain_digest(a, b, cuts):
    groups = ["{}|{}".format(",".join(map(str, a[i:k])), ",".join(map(str, b[j:m])))
              for (i, j), (k, m) in zip([(0, 0), *cuts], cuts, strict=False)]
    return hashlib.sha256(";".join(groups).encode()).hexdigest() if cuts else ""


ODD = [
    (1, "plain words here"), (2, None), (3, ""), (4, " "), (5, "   "), (6, "two  spaces   three "),
    (7, "line\n next\n  more \n\n end\n"), (8, "tab\t here \t x"), (9, "<|endoftext|> <s> </s> <unk>"),
    (10, "the sign ▁ of the pieces"), (11, "<0x41> is not A"), (12, "naïve café 中文字 العربية فارسی"),
    (13, "😀 😀😀 👩‍👩‍👧"), (14, "nbsp  here  and 　 there \u0085 x"), (15, "a" * 300),
    (16, "\x00\x01 \x1c x"), (17, "it's we'll I'd  'twas"), (17, "it's we'll I'd  'twas"),
    (None, "1234567 89 0.5% $3"), (19, "﻿ bom ​ x ᠎ y"), (20, "x " * 700),
    (21, "  a  b   c"), (22, "line\r\n  two \x0b \x0c x"),
]


def test_parts_are_encoded_as_whole_texts(pair):
    """Every character beside a space and another character: splitting changes no id."""
    assert pair.split
    chars = [chr(c) for c in range(0x3200) if not 0xD800 <= c < 0xE000]
    chars += [chr(c) for c in range(0xFE00, 0x10000)] + [chr(c) for c in range(0x1F300, 0x1F400)]
    texts = [f"x{c} {c} y  {c}{c} 1 {c}" for c in chars]
    x = alignment.aligned(pa.array(texts), pair)
    whole = pair.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
    pieces = pair.b.encode(texts)
    for k, text in enumerate(texts):
        a, b = whole[k].ids, pieces[k]
        if b"".join(pair.b_bytes[i] for i in b) != (" " + text).encode():
            a, b = [], []
        assert x.a[x.a_starts[k]:x.a_starts[k + 1]].tolist() == a, text
        assert x.b[x.b_starts[k]:x.b_starts[k + 1]].tolist() == b, text


def test_operator_on_odd_rows(spark, pair):
    docs = spark.createDataFrame([(d, t, 7) for d, t in ODD], "doc_id long, text string, n_a int")
    rows = alignment.align(docs).collect()
    assert len(rows) == len(ODD)
    texts = {r.text: r for r in rows}
    for _, text in ODD:
        r, (a, b, links, cuts) = texts[text], plain(text, pair)
        assert (r.a_ids, r.b_ids) == (a, b)
        assert [tuple(x) for x in r.links] == links and [tuple(x) for x in r.cuts] == cuts
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(cuts), len(links))
        assert r.groups_sha256 == plain_digest(a, b, cuts)
    assert {t for t, r in texts.items() if not r.n_a} >= {None, "", "the sign ▁ of the pieces"}
    assert alignment.align(docs.where("false")).collect() == []


def plain_counts(docs, pair):
    found = [(d, *plain(t, pair)) for d, t in docs]
    held = Counter()
    for _, a, b, links, _ in found:
        held.update({(a[i], b[j]) for i, j in links})
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    return sorted((str(d), len(a), len(b), len(cuts), len(links), plain_digest(a, b, cuts),
                   sum(held[a[i], b[j]] == best[a[i]] for i, j in links),
                   sum(held[a[i], b[j]] for i, j in links)) for d, a, b, links, cuts in found)


def found_counts(df):
    return sorted((str(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best,
                   r.count_sum) for r in df.collect())


@pytest.mark.parametrize("block_bytes", [40, 1 << 20])
def test_counts(spark, pair, block_bytes):
    docs = spark.createDataFrame([(d, t, 7) for d, t in ODD], "doc_id long, text string, block int")
    got = alignment.align_and_count(docs, block_bytes=block_bytes)
    assert set(docs.columns) < set(got.columns)
    assert found_counts(got) == plain_counts(ODD, pair)
    assert alignment.align_and_count(docs.where("false")).collect() == []


def test_lockstep_from_any_stretch(pair, monkeypatch):
    text = " ".join(t or "" for _, t in ODD if t and "▁" not in t) * 3
    want = plain(text, pair)
    for stretch in (1, 7, 10_000):
        monkeypatch.setattr(alignment, "STRETCH", stretch)
        x = alignment.aligned(pa.array(["", text, None]).fill_null(""), pair)
        assert list(zip(x.link_a.tolist(), x.link_b.tolist(), strict=True)) == want[2]
        assert (np.flatnonzero(x.a_cut) + 1).tolist() == [c[0] for c in want[3]]


def test_packed_numbers():
    numbers = np.array([0, 1, 255, 256, 65_536, 2 ** 32 - 1, 7])
    assert alignment.unpack(alignment.pack(numbers), 7).tolist() == numbers.tolist()
    assert alignment.unpack(alignment.pack(numbers[:0]), 0).tolist() == []


def test_registered_query(spark, sf, pair):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", "text").where("length(text) < 2500").collect()]
    got = {r.doc_id: r for r in alignment.op13_lockstep_alignment(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for doc_id, text in docs[:60]:
        a, b, links, cuts = plain(text, pair)
        r = got[doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(cuts), len(links))
        assert r.groups_sha256 == plain_digest(a, b, cuts)
        assert r.n_links <= r.count_sum and r.n_best <= r.n_links


def test_a_block_stays_small(pair):
    """A few workers share an executor: what a block holds at its widest has a bound."""
    text = " ".join(f"word{k % 977} and it" for k in range(200))
    texts = pa.array([text] * (alignment.BLOCK_BYTES // len(text)))
    tracemalloc.start()
    try:
        x = alignment.aligned(texts, pair)
        alignment.written_groups(x)
        alignment._block(x, len(pair.b_bytes))
        assert tracemalloc.get_traced_memory()[1] < 200 << 20
    finally:
        tracemalloc.stop()
