"""Tokens counted in Arrow batches are those of index_tokens."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import index_tokens, query_tokens
from tessera.operators import counted, judging

TEXTS = [
    "", None, " ", "...", "Ab-cd 12ef ab", "Ébène à Straße ŒUVRE œuvre Ǆ ǅ", "“quoted”—dash… it’s", "İstanbul ſtraße ŉ", "Σίσυφος ΣΑΣ", "漢字かな 漢 text漢字x", "Ⱥ ɐ ȺB Ɓa",
    "naïve é combining", "a­b ª º ² ½ µ", "٣٤ १२ x", "emoji 😀 run😀on", "A" * 70, "é" * 70, "tab\tnew\nline\0zero", "_under_score_", "K Å kelvin",
]


@pytest.fixture
def rows(spark):
    rng = random.Random(5)
    every = [chr(c) for c in (*range(1, 0x260), *range(0x2000, 0x2080))]
    mixed = ["".join(rng.choices(every, k=40)) for _ in range(60)] + [" ".join(rng.choices(["the", "Été", "ß", "x1", "y"], k=rng.randrange(60))) for _ in range(60)]
    texts = list(enumerate(TEXTS + every + mixed))
    return spark.createDataFrame([(i * 7, ("a", "b", None)[i // 40 % 3], t) for i, t in texts], "id long, collection string, text string")


def _want(rows):
    return {r["id"]: (r["collection"], r["t"]) for r in rows.select("id", "collection", index_tokens(F.col("text")).alias("t")).collect()}


@pytest.mark.parametrize("part", [30, 4 << 20])
def test_counts_are_those_of_index_tokens(rows, monkeypatch, part):
    monkeypatch.setattr(counted, "PART", part)
    want = _want(rows)
    got = Counter(tuple(r) for r in counted.count_tokens(rows).collect())
    assert got == Counter((i, w, n, len(t)) for i, (_, t) in want.items() for w, n in Counter(t).items())
    words = ["the", "e", "zebra", "ss"]
    asked = Counter(tuple(r) for r in counted.count_tokens(rows, words=pa.array(words)).collect())
    place = {w: i for i, w in enumerate(words)}
    assert asked == Counter((i, w, n, len(t)) for i, (_, t) in want.items() for w, n in Counter(place.get(x) for x in t).items())


@pytest.mark.parametrize("part", [30, 4 << 20])
def test_blocks_hold_all_counts(rows, monkeypatch, part):
    monkeypatch.setattr(counted, "PART", part)
    want, got, lens = _want(rows), Counter(), Counter()
    for b in counted.count_in_blocks(rows).collect():
        assert b["n"] == len(b["ids"]) == len(b["tfs"]) == len(b["lens"]) and b["ids"] == sorted(set(b["ids"]))
        assert (b["max_tf"], b["min_len"]) == (max(b["tfs"]), min(b["lens"])) and {i // 1024 for i in b["ids"]} == {b["slot"]}
        for i, tf, n in zip(b["ids"], b["tfs"], b["lens"]):
            if b["token"] is None:
                lens[(i, b["collection"], n)] += 1
            else:
                got[(i, b["collection"], b["token"], tf, n)] += 1
    assert got == Counter((i, c, w, n, len(t)) for i, (c, t) in want.items() for w, n in Counter(t).items())
    assert lens == Counter((i, c, len(t)) for i, (c, t) in want.items())


def test_no_text_at_all(spark):
    none = spark.createDataFrame([], "id long, collection string, text string")
    assert counted.count_tokens(none).count() == counted.count_in_blocks(none).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, "a", "")], "id long, collection string, text string")
    assert counted.count_tokens(blank).count() == 0 and [tuple(r["ids"]) for r in counted.count_in_blocks(blank.coalesce(1)).collect()] == [(1, 2)]


def test_lexical_judge_is_the_share_of_asked_tokens(spark):
    """Of any letters, for requests longer than what is kept of them, each pair on its own."""
    rng = random.Random(2)
    some = TEXTS + [" ".join(rng.choices(["the", "Été", "ß", "x1", "y"], k=n)) for n in (3, 70, 90)] + [" ".join(f"w{i}" for i in range(80))]
    pairs = spark.createDataFrame([(i, rng.choice(some), rng.choice(some)) for i in range(300)], "k long, request string, text string").repartition(2)
    asked = F.array_distinct(query_tokens(F.col("request")))
    want = F.round(F.size(F.array_intersect(asked, index_tokens(F.col("text")))) / F.nullif(F.size(asked), F.lit(0)), 9)
    got = judging.lexical_judge(pairs)
    assert got.columns == [*pairs.columns, "probability"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, pairs.withColumn("probability", want).collect()))
