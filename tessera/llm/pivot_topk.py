"""Exact top-k by integer inner product: pivot-table elimination.

Components become floor(scale * x). Distances of every vector to many pivots are stored; for a query q and a
candidate x the largest |d(q, p) - d(x, p)| is a lower bound of d(q, x), and so
(|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of their inner product. Candidates are evaluated in the
order of that bound until the next one cannot beat the k-th best score: the answer is exact.

Vectors are ordered by nearest pivot and cut into blocks. Each query first searches its own block, which
gives the score to beat; then lots of queries meet blocks of candidates. Lots are runs of queries in the same
order; from the ranges of pivot distances of a block and a lot follows a bound of all their products, and pairs
of block and lot whose bound is too small are left out before a vector is copied. What is left is bounded
again for each query and block.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part, nor do those of
another length than the smallest id's; of rows that repeat an id the smallest vector counts; copies (after
rounding) are searched once and named by id; ties go to the smaller id; fewer candidates than k are all
returned; sums have to fit into 64 bits; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .vectors import Distinct, best_of, ranked, sound, stack

PIVOTS, PIVOT_SAMPLE, BLOCK, QUERY_BLOCK = 32, 1024, 4096, 2048
_FOUND = "rep long, cand long, score long"


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first: each pivot is the vector farthest from those chosen before."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(sample)) and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(((x - p) ** 2).sum(axis=1))
    return out


def _inner(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where they hold every sum, else in 64-bit integers."""
    size = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if size < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x.astype(np.int64) @ q.astype(np.int64)


def search(x: np.ndarray, ids: np.ndarray, table: np.ndarray, q: np.ndarray, to: np.ndarray, n: int, beat: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """The n best (score, then smaller id) candidates of one query, and how many were evaluated.

    ``ids`` rise. ``beat`` is a score that n candidates elsewhere reach; lower ones are not wanted.
    """
    square = (x.astype(np.float64) ** 2).sum(axis=1)
    own = float((q.astype(np.float64) ** 2).sum())
    bound = np.zeros(len(x))
    for j in range(len(to)):
        np.maximum(bound, np.abs(table[:, j] - to[j]), out=bound)
    bound = np.maximum(bound - 1e-6 * (1 + bound), 0)
    most = (own + square - bound * bound) / 2 + 1e-6 * (1 + own + square)
    order = np.argsort(-most, kind="stable")
    floor = -np.inf if beat is None else float(beat)
    got, score, done, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, max(64, 4 * n)
    while done < len(order):
        batch = order[done : done + step]
        batch = batch[most[batch] >= floor]
        if not len(batch):
            break
        done += len(batch)
        got, score = np.r_[got, batch], np.r_[score, _inner(x[batch], q)]
        keep = np.lexsort((ids[got], -score))[:n]
        got, score = got[keep], score[keep]
        if len(got) == n:
            floor = max(floor, float(score[-1]))
        step *= 2
    return ids[got], score, done


def _pairs(placed: DataFrame, asked: DataFrame, n_blocks: int, n_pivots: int) -> DataFrame:
    """(block, lot) whose ranges of distances leave room for a product that some query of the lot wants."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)

    def ranges(df: DataFrame, key: str, x: str, *more) -> DataFrame:
        each = df.select(key, square(F.col("vector")).alias("size"), "to", *more)
        away = [F.get("to", p) for p in range(n_pivots)]
        lows, highs = (F.array(*map(of, away)).alias(f"{name}_{x}") for name, of in (("low", F.min), ("high", F.max)))
        return settle(each.groupBy(key).agg(lows, highs, F.max("size").alias(f"size_{x}"), *[F.min(m).alias(m) for m in more]))

    blocks = ranges(placed, "block", "b")
    lots = ranges(asked.withColumn("beat", F.coalesce("beat", F.lit(float("-inf")))), "lot", "l", "beat")
    both = lots.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "block")
    apart = F.array_max(F.zip_with(F.zip_with("low_b", "high_l", lambda a, b: a - b), F.zip_with("low_l", "high_b", lambda a, b: a - b), lambda a, b: F.greatest(a, b)))
    gap, sizes = F.greatest(apart, F.lit(0.0)), F.col("size_b") + F.col("size_l")
    return both.where((sizes - gap * gap) / 2 + 1e-5 * (1 + sizes) >= F.col("beat")).select("block", "lot")


def top_products(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k largest products of each row whose id ``every`` divides."""
    rows = embeddings.where(F.col(id_col).isNotNull() & sound(F.col(vector_col)))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    distinct = Distinct(rows.select(F.col(id_col).alias("vec_id"), whole.alias("vector")), every, k)
    reps = distinct.reps
    some = reps.orderBy(F.xxhash64("rep"), "rep").limit(PIVOT_SAMPLE).toPandas()
    if not len(some):
        return distinct.answers(reps.sparkSession.createDataFrame([], _FOUND), k)
    pivots = choose_pivots(stack(some["vector"]), PIVOTS)

    def measure(frames):
        for f in frames:
            if len(f):
                away = to_pivots(stack(f["vector"]), pivots)
                yield f.assign(one=0, near=away.argmin(axis=1), away=away.min(axis=1), to=list(away))[["one", "near", "away", "rep", "asks", "vector", "to"]]

    schema = "one int, near int, away double, rep long, asks boolean, vector array<long>, to array<double>"
    placed = ranked(reps.mapInPandas(measure, schema), "one", "near", "away", "rep")
    placed = settle(placed.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("int")).select("block", "rep", "asks", "vector", "to"))

    def meet(h: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"rep": [], "cand": [], "score": []}).astype("int64")]
        if len(h) and len(q):
            h = h.sort_values("rep")
            x, ids, table = stack(h["vector"], np.int64), h["rep"].to_numpy(), stack(h["to"])
            low, high, longest = table.min(axis=0), table.max(axis=0), float((x.astype(np.float64) ** 2).sum(axis=1).max())
            for rep, vector, to, beat in zip(q["rep"], q["vector"], q["to"], q["beat"]):
                v, to = np.array(vector, np.int64), np.array(to)
                beat = None if beat is None or beat != beat else int(beat)
                gap = max(float(np.maximum(low - to, to - high).max()), 0.0)
                own = float((v.astype(np.float64) ** 2).sum())
                if beat is not None and (own + longest - gap * gap) / 2 + 1e-5 * (1 + own + longest) < beat:
                    continue
                got, score, _ = search(x, ids, table, v, to, k + 1, beat)
                out.append(pd.DataFrame({"rep": rep, "cand": got, "score": score}))
        return pd.concat(out)

    asks = placed.where("asks").toDF(*placed.columns)
    own = placed.join(asks.select("block").distinct(), "block", "left_semi").groupBy("block")
    first = settle(best_of(own.cogroup(asks.withColumn("beat", F.lit(None).cast("double")).groupBy("block")).applyInPandas(meet, _FOUND), k))
    beat = first.groupBy("rep").agg(F.when(F.count("*") > k, F.min("score")).cast("double").alias("beat"))
    asks = asks.join(beat, "rep", "left")
    n_blocks = placed.agg(F.max("block")).first()[0] + 1
    asked = ranked(asks.withColumnRenamed("block", "home").withColumn("one", F.lit(0)), "one", "home", "rep")
    asked = settle(asked.withColumn("lot", F.floor(F.col("pos") / QUERY_BLOCK).cast("int")).drop("pos", "one"))
    survivors = settle(_pairs(placed, asked, n_blocks, len(pivots)))
    held = placed.join(survivors, "block").select("block", "lot", "rep", "vector", "to")
    asked = asked.join(survivors, "lot").where("block <> home")
    found = held.groupBy("block", "lot").cogroup(asked.groupBy("block", "lot")).applyInPandas(meet, _FOUND)
    return distinct.answers(settle(best_of(found.unionByName(first), k)), k)
