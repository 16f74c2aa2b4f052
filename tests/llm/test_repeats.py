"""Repeated passages against comparing all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from vouch.llm import repeats as R


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        left = bytes(b for b, g in zip(r, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdeé \n") for _ in range(n))
    common = [word(n) for n in (15, 24, 25, 26, 60, 200)]
    texts = [word(rng.randint(0, 150)) for _ in range(30)]
    for _ in range(60):
        texts.append("".join(rng.choice([word(rng.randint(0, 40)), rng.choice(common)])
                             for _ in range(rng.randint(1, 5))))
    base = word(300)
    for _ in range(15):  # near copies
        k = rng.randrange(300)
        texts.append(base[:k] + rng.choice("xyz") + base[k + 1:])
    return texts + [base, base, "", None, "a" * 90, "a" * 26, "ab" * 50, word(7) * 20, None, ""]


@pytest.mark.parametrize(("seed", "hot"), [(1, 1000), (2, 3), (3, 0)])
def test_all_windows(spark, seed, hot):
    texts = made(seed)
    rows = [(i if i % 7 else None, t, i) for i, t in enumerate(texts)] + [(0, texts[3], 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = R.without_repeats(df, keep=["doc_id"], length=25, gram=8, key_segments=hot)
    want = brute([t for _, t, _ in rows], 25)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                   for r in got.collect()), key=repr) == sorted(
        ((rows[i][0], *w) for i, w in enumerate(want)), key=repr)
    assert R.without_repeats(df.where("false"), keep=["doc_id"]).count() == 0


def test_run_index_equals_all_windows():
    rng = random.Random(9)
    for _ in range(60):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 60)))
                   for _ in range(rng.randint(1, 8))]
        least = rng.randint(1, 9)
        seen = Counter(s[i:i + least] for s in strings for i in range(len(s) - least + 1))
        marks = R.RunIndex(strings).marks(least)
        for s, ranges in zip(strings, marks):
            gone = np.zeros(len(s), bool)
            for i in range(len(s) - least + 1):
                gone[i:i + least] |= seen[s[i:i + least]] > 1
            got = np.zeros(len(s), bool)
            for a, b in ranges:
                assert b <= len(s)
                got[a:b] = True
            assert (gone == got).all()


def test_transform_is_run_length_compressed():
    strings = [b"the same passage again and again, " * 30] * 6
    index = R.RunIndex(strings)
    assert len(index.runs) < len(index.symbols) / 10


def test_suffixes_beyond_packed_size():
    index = R.RunIndex([b"banana" * 3, b"ananas"])
    text = index.symbols.tolist()
    suffixes = sorted(range(len(text)), key=lambda i: text[i:])
    again = R.RunIndex.__new__(R.RunIndex)
    again.symbols = index.symbols
    assert again._sorted(258).tolist() == suffixes
    assert again._sorted(1 << 22).tolist() == suffixes  # two numbers instead of one
