"""The index against plain search, and repeated windows against brute force."""

import numpy as np
import pytest

from tessera.llm import repeats
from tessera.llm.fm_index import FMIndex, WaveletMatrix, Windows


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 37, 500)
    matrix = WaveletMatrix(values, 6)
    ask, at = rng.integers(0, 37, 300), rng.integers(0, 501, 300)
    assert matrix.rank(ask, at).tolist() == [int((values[:i] == v).sum()) for v, i in zip(ask, at)]


def test_backward_search_counts():
    rng = np.random.default_rng(1)
    rows = [rng.integers(5, 9, rng.integers(1, 40)) for _ in range(30)]
    symbols = np.concatenate([np.r_[r, 0] for r in rows])
    ends = np.cumsum([len(r) + 1 for r in rows]) - 1
    separator = np.zeros(len(symbols), bool)
    separator[ends] = True
    index = FMIndex(symbols, separator)
    for _ in range(200):
        pattern = rng.integers(5, 10, rng.integers(1, 8))
        low, high = np.zeros(1, np.int64), np.array([len(symbols)])
        for s in pattern[::-1]:
            low, high = index.extend(index.encode(np.array([s])), low, high)
            if low[0] >= high[0]:
                break
        want = sum(r[i : i + len(pattern)].tolist() == pattern.tolist() for r in rows for i in range(len(r)))
        assert high[0] - low[0] == want


def test_streams_with_windows_that_the_index_lacks():
    rng = np.random.default_rng(2)
    rows = [rng.integers(1, 4, 30) for _ in range(12)]
    symbols = np.concatenate([np.r_[r, 0] for r in rows])
    separator = symbols == 0
    label = np.repeat(rng.permutation(12), 31)
    asked = [rng.integers(1, 5, 25) for _ in range(20)]
    stream = np.concatenate(asked)
    got = Windows(symbols, separator, label, 5).scan(stream, np.arange(20) * 25, np.full(20, 21), 99)
    names = {}
    for i, r in enumerate(rows):
        for j in range(26):
            t = tuple(r[j : j + 5].tolist())
            names[t] = min(names.get(t, 99), int(label[31 * i]))
    want = [names.get(tuple(a[j : j + 5].tolist()), 99) for a in asked for j in range(21)]
    assert got.tolist() == want and 99 in want and len(set(want)) > 3


def brute(rows, window=13):
    first = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone.update(range(j, j + window))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_repeats_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(docs).collect()}
    assert got == want and any(g for _, g, _ in want.values())


@pytest.mark.parametrize("shard,hot", [(50, None), (120_000, None), (30, 1)])
def test_repeats_cases(spark, monkeypatch, shard, hot):
    monkeypatch.setattr(repeats, "SHARD_SEGMENTS", shard)
    if hot:  # every repeated minimizer counts as hot
        mark = repeats._mark

        def all_hot(docs, window):
            marks, shards = mark(docs, window)

            class Every(repeats.Marks):
                pass

            keys = {int(k) for r in docs.collect() for k in repeats._segments(np.frombuffer((r.text or "").encode(), np.uint8), np.array([0, len((r.text or "").encode())]), window)[4]}
            return repeats.Marks(marks.bits, np.array(sorted(keys), np.uint64)), shards

        monkeypatch.setattr(repeats, "_mark", all_hot)
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(60))
    fill = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 40, n))
    texts = [f"{fill(50)} {passage} {fill(30)}" for _ in range(40)] + [None, "", "a b", passage, f"{passage}\n{passage}", "x " * 400, "x\t" * 30, "same " * 12]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(docs).collect()}
    assert got == brute(rows)


def test_no_documents(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.kept) for r in repeats.remove_repeats(odd).collect()) == [(0, "a b"), (1, "a b")]


def test_repeated_ids_long_texts_and_clashing_columns(spark):
    passage, long = " ".join(f"p{i}" for i in range(20)), " ".join(f"v{i}" for i in range(300_000))
    rows = [(1, passage), (2, f"own {passage}"), (2, "other words of the same id"), (2, f"{passage} end"), (2, f"own {passage}"), (3, long), (4, f"{long} tail")]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, starts string, mark string, _id int")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeats.remove_repeats(docs).collect())
    assert got[0] == (1, 20, 0, passage) and got[6][:3] == (4, 300_001, 300_000)
    assert got[1:5] == [(2, 6, 0, "other words of the same id"), (2, 21, 20, "end"), (2, 21, 20, "own"), (2, 21, 20, "own")]
