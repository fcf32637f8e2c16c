"""Places of rows within their groups, where one group may hold a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df``, written once in order, with _group (a number for each value of ``group``, null included), _pos (from 0) and _size.

    Rows are range-partitioned by group and order, so a group takes as many tasks as it needs; equal rows are told apart
    by where they were read. A table with a row for each group and partition then says where a run of rows begins.
    """
    keys = [group, *order]
    read = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = read.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    dealt = settle(dealt.withColumns({"_part": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    runs = dealt.groupBy(F.col("_part").alias("_p"), F.col(group).alias("_of")).agg(F.count("*").alias("_n"), F.min("_i").alias("_low"))
    whole = W.partitionBy("_of")
    runs = runs.withColumns(
        {
            "_start": F.coalesce(F.sum("_n").over(whole.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("_low"),
            "_size": F.sum("_n").over(whole),
            "_group": F.min("_low").over(whole),
        }
    )
    found = dealt.join(runs, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_of")))
    return found.withColumn("_pos", F.col("_i") + F.col("_start")).drop("_part", "_i", "_p", "_of", "_n", "_low", "_start")


def united(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
