"""Distinct vectors, their copies, global ranks and best-k merging, for the two vector searches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle


def sound(vector: Column) -> Column:
    """No null, no null component, and all finite."""
    finite = lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


class Distinct:
    """Vectors once each, with the smallest id as representative; only as many copies as an answer can name."""

    def __init__(self, rows: DataFrame, every: int, k: int):
        """rows: vec_id and vector (an array), all sound.

        Vectors of another length than the smallest id's take no part; of rows that repeat an id the smallest vector counts.
        """
        length = rows.groupBy("vec_id").agg(F.max(F.size("vector")).alias("n")).agg(F.min_by("n", "vec_id").alias("n"))
        rows = rows.withColumn("_n", length.scalar()).where(F.size("vector") == F.col("_n")).groupBy("vec_id").agg(F.min("vector").alias("vector"))
        rows = settle(rows)
        self.reps = settle(rows.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.max(F.col("vec_id") % every == 0).alias("asks")))
        in_order = W.partitionBy("vector").orderBy("vec_id")
        few = rows.withColumn("_at", F.row_number().over(in_order)).where(F.col("_at") <= k + 1)
        self.copies = few.join(self.reps.select("vector", "rep"), "vector").select("rep", "vec_id")
        self.queries = rows.where(F.col("vec_id") % every == 0).join(self.reps.select("vector", "rep"), "vector").select(F.col("vec_id").alias("query_id"), "rep")

    def answers(self, found: DataFrame, k: int) -> DataFrame:
        """From (rep, cand, score), each representative's k + 1 best, to query_id, rank, vec_id and score."""
        best = found.groupBy("rep").agg(F.collect_list(F.struct("cand", "score")).alias("best"))  # k + 1 each
        named = found.select("cand").distinct().join(self.copies.withColumnRenamed("rep", "cand"), "cand").groupBy("cand").agg(F.collect_list("vec_id").alias("ids"))
        asked = self.queries.join(best, "rep").select("query_id", F.explode("best").alias("b")).select("query_id", "b.cand", "b.score")
        rows = asked.join(named, "cand").select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return rows.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 best distinct candidates of each representative; a pair found several times has its best score."""
    place = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "cand"))
    return found.groupBy("rep", "cand").agg(F.max("score").alias("score")).withColumn("_at", place).where(F.col("_at") <= k + 1).drop("_at")


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Add ``pos``, the place of each row from 0 within its group in the given order.

    Rows are range-partitioned and sorted; only a count per group and partition goes to all tasks.
    """
    dealt = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    placed = settle(dealt.withColumn("_i", F.monotonically_increasing_id()))
    part = F.shiftright("_i", 33)
    counts = placed.groupBy(group, part.alias("_p")).agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    starts = settle(counts.withColumn("_start", F.coalesce(before, F.lit(0)) - F.col("_first")).select(group, "_p", "_start"))
    joined = placed.withColumn("_p", part).join(F.broadcast(starts), [group, "_p"])  # one row per partition and group
    return joined.withColumn("pos", F.col("_i") + F.col("_start")).drop("_i", "_p", "_start")


def stack(vectors, dtype=np.float64) -> np.ndarray:
    return np.array(vectors.tolist(), dtype) if len(vectors) else np.zeros((0, 0), dtype)
