"""Piece encoding against the library, against unsplit texts, and as an exact round trip."""

import random
import struct

import numpy as np
import pytest
import sentencepiece

from vouch.llm import pieces as P


@pytest.fixture(scope="module")
def vocabulary():
    return P.Pieces.load(P.default_model())


def unigram_copy(path, scores):
    """The library's processor with the same pieces and given scores, set to search the best total
    score: field 3 (model type) of field 2 (trainer) of the model file is 1 instead of 2; field 2
    (score) of each field 1 (piece) is replaced."""
    data = open(path, "rb").read()
    at, out = 0, bytearray()

    def varint(buf, at):
        value = shift = 0
        while True:
            b = buf[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    while at < len(data):
        start = at
        key, at = varint(data, at)
        assert key & 7 == 2
        size, at = varint(data, at)
        body = data[at:at + size]
        if key >> 3 == 1:
            n = body[1]
            score = struct.pack("<f", scores.get(body[2:2 + n].decode(), 0.0))
            assert body[0] == 10 and body[2 + n] == 21
            body = body[:3 + n] + score + body[7 + n:]
        if key >> 3 == 2:
            k, b = 0, bytearray(body)
            while k < len(b):
                field, k = varint(b, k)
                if field & 7 == 2:
                    n, k = varint(b, k)
                    k += n
                elif field & 7 == 5:
                    k += 4
                else:
                    if field >> 3 == 3:
                        b[k] = 1
                    _, k = varint(b, k)
            body = bytes(b)
        out += data[start:at] + body
        at += size
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(out))


TEXTS = ["Hello world", "a", "the  two   spaces ", " lead", "trail \n\tnew\r\nline", "é ß 日本語 😀 ▁ x",
         "<0x0A> <s> </s>", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x" * 300, " " * 50, "\0\x1c",
         "Die Straße heißt ñandú", "🏳️‍🌈" * 5]


def test_same_as_the_library(vocabulary):
    library = unigram_copy(P.default_model(), {
        k.replace(" ", "▁"): v[1] for k, v in vocabulary.steps.items() if v})
    rng = random.Random(1)
    words = ["Hello", "world", "internationalization", "the", "ofthstthor", "chllades", "Straße",
             "naïve", "x1y2", "can't", "don't,", "(ok)", "é", "thoningin"]
    for _ in range(200):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))
        assert vocabulary.ids(vocabulary.encode(text)).tolist() == library.encode(text), text


@pytest.mark.parametrize("text", TEXTS)
def test_round_trip(vocabulary, text):
    ids = vocabulary.ids(vocabulary.encode(text)).tolist()
    assert vocabulary.decode(ids)[1:].decode() == text
    assert all(0 <= i < 32000 for i in ids)
    assert vocabulary.encode(text) == vocabulary.segment(" " + text)


def test_scan_is_the_product_from_the_left():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 7, 16, 21):
        m = rng.integers(-9, 9, (n, 4, 4)).astype(float)
        m[rng.random((n, 4, 4)) < 0.3] = P.LOW
        want = [m[0]]
        for x in m[1:]:
            want.append(P.multiply(want[-1], x))
        assert np.array_equal(P.scan(m), np.stack(want))


def test_chunks_give_the_same_pieces(spark, vocabulary):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, "".join(rng.choice("ab  e\nthtion日▁") for _ in range(rng.randint(0, 700))))
             for i in range(12)]
    rows += [(200, None), (201, ""), (None, "word " * 400), (202, "thtionthe" * 90), (202, "x y " * 99)]
    df = spark.createDataFrame([(a, b, "extra") for a, b in rows], "doc_id long, text string, row string")
    split = P.encode(df, chunk=32, keep=["doc_id", "text", "row"])
    got = sorted(((r.doc_id, r.text, r.ids, r.n_pieces, r.ids_digest, r.round_trip, r.row)
                  for r in split.collect()), key=repr)
    lengths = P._lengths(vocabulary)
    want = []
    for d, t in rows:
        edges = vocabulary.segment(" " + t) if t else []
        ids = vocabulary.ids(edges).tolist()
        want.append((d, t if t else "", ids, len(ids), P.digest(edges, 0, lengths), True, "extra"))
    got = [(d, t or "", *rest) for d, t, *rest in got]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    back = P.decode(split.select("doc_id", "text", "ids"))
    assert all((r.text or "") == r.decoded for r in back.collect())
    whole = P.encode(df, keep=["doc_id"], with_ids=False)
    assert sorted(whole.select("doc_id", "ids_digest").collect(), key=repr) == sorted(
        split.select("doc_id", "ids_digest").collect(), key=repr)
    assert P.encode(df.where("false")).count() == 0


def test_words_segmented_together_equal_each_alone(vocabulary, monkeypatch):
    rng = random.Random(4)
    alphabet = "  aeinrstlo,.1_\u00e9\u4e2d\U0001f600\x00\u05d0"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 90))) for _ in range(600)]
    words += [" the", " international", "x", " ", "\x00", "ab" * 40, " information" * 3]
    for at_once in (1, 500, 1 << 18):
        monkeypatch.setattr(P, "AT_ONCE", at_once)
        way, numbers = P._segmented(vocabulary, words)
        got = [w.tolist() for w in np.split(way, np.cumsum(numbers)[:-1])]
        assert got == [vocabulary.segment(w) for w in words]
    for none in ([], ["ab" * 40]):
        way, numbers = P._segmented(vocabulary, none)
        assert way.tolist() == [e for w in none for e in vocabulary.segment(w)] and len(numbers) == len(none)
