"""Approximate nearest neighbours by shifted space-filling curves.

Unit vectors are projected several times to a few coordinates, shifted, and ordered along a Hilbert curve.
Each ordering is range-partitioned and cut into blocks of consecutive keys; a query meets every block that
its key window touches, in each ordering, and the candidates are merged and ranked by exact cosine.

The window is fitted: for at most ``sample`` queries the true neighbours are found by one scan; for each number
of orderings the window is what would have caught the ``aim`` share of them, and the number that meets the fewest
candidates is used (two at least). Where vectors cluster, that is a few keys in all orderings; on vectors without
structure no curve brings neighbours together, the window grows with the table and few wide orderings are cheaper.

A block that many queries ask for is dealt out to lots of QUERY_LOT queries; blocks that none asks for stay put.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
those of another length than the smallest id's; of rows that repeat an id the smallest vector counts; copies
are searched once and named by id; ties go to the smaller id; a query with fewer candidates gets them all;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .vectors import Distinct, best_of, ranked, sound, stack

ORDERINGS, COORDINATES, BITS, SEED = 8, 6, 9, 11
BLOCK, QUERY_LOT, SAMPLE, AIM, LEAST_WINDOW = 2048, 1024, 96, 0.96, 256


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points with integer coordinates below 2**bits."""
    x, dims = [c.astype(np.int64).copy() for c in cells.T], cells.shape[1]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(dims):  # reflect where the bit is set, else exchange the low bits with the first axis
            is_set = (x[i] >> level) & 1 == 1
            swap = np.where(is_set, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(is_set, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ turn) >> level) & 1)
    return key


def curve_keys(units: np.ndarray, ordering: int) -> np.ndarray:
    """Keys of unit vectors in one of the orderings."""
    rng = np.random.default_rng([SEED, ordering])
    dims = units.shape[1]
    axes = np.linalg.qr(rng.normal(size=(dims, max(1, min(dims, COORDINATES)))))[0]
    spread = 0.5 + 0.5 * np.tanh(0.8 * np.sqrt(dims) * (units @ axes))
    shifted = (spread + rng.random(axes.shape[1])) / 2
    return hilbert(np.minimum((shifted * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _unit(vectors) -> np.ndarray:
    x = stack(vectors)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cosine(asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    dots = asked @ held.T
    return dots / (np.sqrt((asked * asked).sum(axis=1))[:, None] * np.sqrt((held * held).sum(axis=1)))


def _top(asked: np.ndarray, asked_ids: np.ndarray, held: np.ndarray, held_ids: np.ndarray, n: int) -> pd.DataFrame:
    """The n best candidates of each asked vector, ties to the smaller id.

    Products of blocks differ in their last bits with the shape of the block, so they only choose who is near
    enough; the score of a pair is summed from its own two rows and is the same in every block.
    """
    scores = _cosine(asked, held)
    if scores.shape[1] > n:
        least = -np.partition(-scores, n - 1, axis=1)[:, n - 1] - 1e-12
    else:
        least = np.full(len(scores), -np.inf)
    row, col = np.nonzero(scores >= least[:, None])
    own = np.empty(len(row))
    for i in range(0, len(row), 1 << 16):  # many more than n where near copies tie
        x, y = asked[row[i : i + (1 << 16)]], held[col[i : i + (1 << 16)]]
        own[i : i + (1 << 16)] = (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))
    got = pd.DataFrame({"rep": asked_ids[row], "cand": held_ids[col], "score": own})
    return got.sort_values(["rep", "score", "cand"], ascending=[True, False, True]).groupby("rep").head(n)


_FOUND = "rep long, cand long, score double"


def _true_neighbours(reps: DataFrame, sample: int, k: int) -> DataFrame:
    some = reps.where("asks").orderBy(F.xxhash64("rep"), "rep").limit(sample).toPandas()
    if not len(some):
        return reps.sparkSession.createDataFrame([], _FOUND)
    asked, ids = stack(some["vector"]), some["rep"].to_numpy()

    def scan(frames):
        for f in frames:
            if len(f):
                yield _top(asked, ids, stack(f["vector"]), f["rep"].to_numpy(), k + 1)

    return settle(best_of(reps.select("rep", "vector").mapInPandas(scan, _FOUND), k))


def _window(keyed: DataFrame, truth: DataFrame, aim: float, last: int) -> tuple[int, int]:
    """The number of orderings, and the keys to look at on either side so that the share ``aim`` of true neighbours is met."""
    place = lambda x: keyed.select(F.col("rep").alias(x), "ordering", F.col("pos").alias(f"pos_{x}"))
    pairs = truth.where("rep <> cand").select(F.col("rep").alias("a"), F.col("cand").alias("b"))
    pairs = F.broadcast(pairs)  # at most k + 1 for each sampled query
    one = place("a").join(pairs, "a")
    both = settle(place("b").join(F.broadcast(one), ["ordering", "b"]).select("ordering", "a", "b", F.abs(F.col("pos_a") - F.col("pos_b")).alias("gap")))
    best = (ORDERINGS, LEAST_WINDOW, float("inf"))
    for n in range(min(2, ORDERINGS), ORDERINGS + 1):
        gaps = both.where(F.col("ordering") < n).groupBy("a", "b").agg(F.min("gap").alias("gap"))
        window = max(LEAST_WINDOW, int(gaps.agg(F.percentile("gap", F.lit(aim))).first()[0] or 0))
        cost = n * min(2 * window + BLOCK, last + 1)
        if cost < best[2]:
            best = (n, window, cost)
    return best[:2]


def nearest(embeddings: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, aim: float = AIM) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest found of each row whose id ``every`` divides."""
    rows = embeddings.where(F.col(id_col).isNotNull() & sound(F.col(vector_col)) & F.exists(vector_col, lambda x: x != 0))
    distinct = Distinct(rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")), every, k)
    reps = distinct.reps

    def order(frames):
        for f in frames:
            if len(f):
                unit = _unit(f["vector"])
                for o in range(ORDERINGS):
                    yield f.assign(ordering=o, key=curve_keys(unit, o))[["ordering", "key", "rep", "asks", "vector"]]

    schema = reps.select(F.lit(0).alias("ordering"), F.lit(0).cast("long").alias("key"), "rep", "asks", "vector").schema
    keyed = settle(ranked(reps.mapInPandas(order, schema), "ordering", "key", "rep"))
    last = keyed.agg(F.max("pos")).first()[0] or 0
    orderings, window = _window(keyed, _true_neighbours(reps, sample, k), aim, last)
    keyed = keyed.where(F.col("ordering") < orderings)
    block = lambda at: F.floor(at / F.lit(BLOCK)).cast("long")
    reach = F.sequence(block(F.greatest(F.col("pos") - window, F.lit(0))), block(F.least(F.col("pos") + window, F.lit(last))))
    asked = keyed.where("asks").toDF(*keyed.columns).select("ordering", F.explode(reach).alias("block"), "rep", "vector")
    lots = settle(asked.groupBy("ordering", "block").agg(F.ceil(F.count("*") / F.lit(QUERY_LOT)).cast("int").alias("lots")))
    asked = asked.join(lots, ["ordering", "block"]).withColumn("lot", F.pmod(F.xxhash64("rep"), "lots").cast("int"))
    held = keyed.select("ordering", block(F.col("pos")).alias("block"), "rep", "vector").join(lots, ["ordering", "block"])
    held = held.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))

    def rerank(h: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(h) or not len(q):
            return pd.DataFrame({"rep": [], "cand": [], "score": []}).astype({"rep": "int64", "cand": "int64", "score": "float64"})
        q = q.sort_values("rep")
        x, held_ids = stack(h["vector"]), h["rep"].to_numpy()
        parts = [_top(stack(p["vector"]), p["rep"].to_numpy(), x, held_ids, k + 1) for p in (q.iloc[i : i + 512] for i in range(0, len(q), 512))]
        return pd.concat(parts)

    same = ("ordering", "block", "lot")
    found = held.select(*same, "rep", "vector").groupBy(*same).cogroup(asked.select(*same, "rep", "vector").groupBy(*same)).applyInPandas(rerank, _FOUND)
    return distinct.answers(settle(best_of(found, k)), k)
