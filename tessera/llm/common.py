"""Shared folder, table reading and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one in local sessions alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def settle(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write a table into the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def held_out(doc_id="doc_id"):
    """True for the fifth of the rows that no model may learn from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def utf8_slices(column: pa.Array, limit: int = 1 << 20):
    """Cut an Arrow string column into runs of rows of about ``limit`` bytes.

    Yields (first row, last row + 1, bytes as uint8, row offsets into them). A null counts as empty.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, last, raw[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def free_name(df: DataFrame, wish: str) -> str:
    """A name for a helper column that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    name = f"_{wish}"
    while name in taken:
        name += "_"
    return name


#: Keys of more than this part of all rows are joined by broadcast; there are at most so many.
HOT_PARTS = 4096


def join_hot(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows and their key's group, where a key may hold a large part of all rows.

    ``groups`` has a key once with the number of its rows as ``size``. Keys of more than 1 / HOT_PARTS of all
    those rows number less than HOT_PARTS, so they can be broadcast; the others meet in an ordinary join.
    """
    whole = groups.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n"))
    hot = groups.where(F.col(size) * HOT_PARTS > whole.scalar())
    hot = settle(hot)
    cold = groups.join(F.broadcast(hot.select(key)), key, "left_anti")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return rest.unionByName(rows.join(F.broadcast(hot), key))
