"""Encoding against the original library, the scan against the whole text, and exact round trips."""

import numpy as np
import pytest
import sentencepiece

from tessera.llm import pieces, queries

PATH = queries.piece_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load(PATH)


def _texts():
    rng = np.random.default_rng(0)
    parts = ["the", "tion", "é", " ", "  ", "ß", "\n", "漢字", "ing", "x", "😀", ".", "http://", "ab", "er", "   ", "A", "\t", "un", "1", "***"]
    return ["", " ", "a", "  a  b ", "hello  world", "x" * 70, " " * 40, "\n\n"] + ["".join(rng.choice(parts, rng.integers(1, 60))) for _ in range(400)]


def test_encoding_equals_the_library(library, vocabulary):
    for t in _texts():
        ids = np.frombuffer(vocabulary.encode(t), "<i4").tolist()
        assert ids == library.encode(t), t
        assert vocabulary.decode(vocabulary.encode(t)) == t


def test_words_merged_together_equal_the_library(library, vocabulary):
    rng = np.random.default_rng(7)
    parts = ["the", "tion", "é", "ß", "ing", "x", ".\n", "http://", "er", "A", "un", "1\t", "***", "ll", "l"]
    words = sorted({"".join(rng.choice(parts, rng.integers(1, 9))) for _ in range(3000)})
    words = [w for w in words if len(w) < 40]
    assert [np.frombuffer(b, "<i4").tolist() for b in vocabulary.many(words)] == library.encode(words)


def test_products_in_any_grouping():
    rng = np.random.default_rng(1)
    matrices = [np.where(rng.random((4, 4)) < 0.4, rng.normal(size=(4, 4)), -np.inf) for _ in range(13)]
    whole = matrices[0]
    for m, got in zip(matrices[1:], pieces.scan(matrices)[1:]):
        whole = pieces.combine(whole, m)
        assert np.allclose(whole, got, equal_nan=True)


@pytest.mark.parametrize("chunk", [32, 45, 64, 200])
def test_chunks_equal_the_whole(vocabulary, library, chunk):
    rng = np.random.default_rng(chunk)
    parts = ["tion", "the", "er", "in", "xy", "ing", "a", "b", "é", "st"]
    texts = ["".join(rng.choice(parts, 300)), " ".join(rng.choice(parts, 200)), "z" * 500, " " * 300, "".join(rng.choice([*parts, "  ", " "], 300)), "漢字かな" * 60]
    for t in texts:
        whole = pieces.SPACE + t.replace(" ", pieces.SPACE)
        around, cuts, args = 2 * vocabulary.longest, list(range(0, len(whole), chunk)), []
        for c in cuts:
            low, high = max(0, c - around), min(len(whole), c + chunk + around)
            args.append((whole[low:high], c - low, min(len(whole), c + chunk) - low))
        states = pieces.boundary_states([vocabulary.matrix(*a) for a in args])
        ids = b"".join(vocabulary.chunk(*a, *s) for a, s in zip(args, states))
        assert np.frombuffer(ids, "<i4").tolist() == library.encode(t)


def test_encode_in_spark(spark, library):
    texts = [None, "", "a b", "long words " * 40, "tionerthe" * 60, "x  y " * 50]
    rows = [(i, t, "old") for i, t in enumerate(texts)] + [(4, texts[4], "again"), (None, texts[3], "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encode(docs, PATH, chunk=64)
    back = pieces.decoder(docs, PATH)
    out = got.withColumn("back", back("ids")).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.back == r.text
        assert (r.ids is None) == (r.text is None)
        if r.text is not None:
            assert np.frombuffer(bytes(r.ids), "<i4").tolist() == library.encode(r.text)
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def test_query_round_trips(spark, library):
    got = {r.doc_id: r for r in queries.op7_pieces(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert all(r.round_trip for r in got.values()) and len(got) == len(docs)
    assert all(got[d.doc_id].n_ids == len(library.encode(d.text)) for d in docs)
