"""Stores kept on disk: sources replaced by rewriting their folders, payloads read by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..sources.shared import materialize
from ..sources.tables import SOURCE_BUCKETS, buckets_of, source_bucket, stored_memory, write_memory
from .compact import pages

_KEYS = ["collection", "source_id"]
_PLACE = ["collection", "source_bucket"]


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def _delete(spark: SparkSession, folders: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for folder in folders:
        at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _marked(touched: DataFrame, path: str) -> tuple[DataFrame, list[Row], int]:
    """Rows of the folders that hold a source of ``touched``, with ``_gone`` for its own; these folders; and the largest number of buckets."""
    spark = touched.sparkSession
    stored = stored_memory(spark, path)
    # a row for each folder; only the folders' names and the files' row counts are looked at
    there = materialize(stored.select(*_PLACE, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct())
    counts = [r[0] for r in there.select(buckets_of(F.col("source_bucket"))).distinct().collect()]
    hit = []
    if counts:
        asked = touched.select("collection", F.explode(F.array(*(source_bucket(F.col("source_id"), n) for n in counts))).alias("source_bucket")).distinct()
        hit = there.join(asked, _PLACE, "left_semi").collect()
    own = stored.where(F.concat_ws("/", *_PLACE).isin([f"{r['collection']}/{r['source_bucket']}" for r in hit]))
    rows = own.join(touched.withColumn("_gone", F.lit(True)), _same(own, touched, _KEYS), "left").select(*(own[c] for c in own.columns), F.col("_gone").isNotNull().alias("_gone"))
    return rows, hit, max(counts, default=SOURCE_BUCKETS)


def _touched(new: DataFrame, emptied: DataFrame | None) -> DataFrame:
    rows = new.select(_KEYS) if emptied is None else new.select(_KEYS).unionByName(emptied.select(_KEYS))
    return materialize(rows.distinct())


def stored_sources(path: str, new: DataFrame, emptied: DataFrame | None = None) -> DataFrame:
    """What a store holds of the sources (collection, source_id) of ``new`` and ``emptied``; only their folders are read."""
    if not _exists(new.sparkSession, path):
        return new.limit(0)
    return _marked(_touched(new, emptied), path)[0].where("_gone").drop("_gone", "source_bucket")


def replace_stored(new: DataFrame, path: str, emptied: DataFrame | None = None) -> DataFrame:
    """Replace in a store every (collection, source_id) of ``new``, and remove those of ``emptied``; returns the rows removed.

    Only the folders of these sources are read and written; within a folder that is rewritten, other sources' rows stay. What is
    written is settled first, so a job that is lost on the way can be repeated. A null source_id is a source like any other.
    One writer at a time: rows appended to a folder while it is rewritten would be lost.
    """
    spark = new.sparkSession
    if not _exists(spark, path):
        write_memory(new, path)
        return new.limit(0)
    rows, hit, buckets = _marked(_touched(new, emptied), path)
    rows = materialize(rows)
    gone = rows.where("_gone").drop("_gone", "source_bucket")
    fresh = new.select(gone.columns).withColumn("source_bucket", source_bucket(F.col("source_id"), buckets))
    kept = materialize(rows.where("not _gone").drop("_gone").unionByName(fresh))
    filled = {(r["collection"], r["source_bucket"]) for r in kept.select(_PLACE).distinct().collect()}
    dealt = kept.repartition(*_PLACE, F.pmod(F.xxhash64("id"), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PLACE).parquet(path)
    _delete(spark, [r["folder"] for r in hit if (r["collection"], r["source_bucket"]) not in filled])
    return gone


def _shelf(pointer: Column) -> Column:
    return F.concat(F.lit("p"), F.substring(F.sha2(pointer, 256), 1, 2))


def write_pages(elisions: DataFrame, path: str, page_bytes: int | None = None, settings: Settings = DEFAULTS) -> None:
    """Store payloads as pages, sorted by pointer in small row groups within 256 folders; a payload may be stored again."""
    rows = pages(elisions, page_bytes, settings).withColumn("shelf", _shelf(F.col("pointer")))
    # a folder's rows are dealt by pointer too, so that no task holds more than some payloads
    dealt = rows.repartition("shelf", F.pmod(F.xxhash64("pointer"), F.lit(16))).sortWithinPartitions("shelf", "pointer", "page")
    dealt.write.mode("append").options(**{"parquet.block.size": 1 << 20, "parquet.page.row.count.limit": 16, "parquet.enable.dictionary": "false"}).partitionBy("shelf").parquet(path)


#: Up to so many pages asked at once are filters that Parquet skips by; more are joined, folders are pruned either way.
LITERAL = 64


def expand_stored(requests: DataFrame, path: str) -> DataFrame:
    """As ``expand``, from stored pages: of a payload the page that is asked and, to tell its end from an unknown pointer, its first.

    Requests keep all their columns; a null page is the first one, a null pointer is unknown.
    """
    spark = requests.sparkSession
    asked = materialize(requests.withColumn("_page", F.greatest(F.coalesce("page", F.lit(0)), F.lit(0)).cast("int")))
    wanted = materialize(asked.select("pointer", F.explode(F.array("_page", F.lit(0))).alias("page")).where("pointer is not null").distinct())
    shelves = [r[0] for r in wanted.select(_shelf(F.col("pointer"))).distinct().collect()]
    rows = spark.read.schema("pointer string, page int, data binary, shelf string").parquet(path).where(F.col("shelf").isin(shelves)).drop("shelf")
    some = wanted.limit(LITERAL + 1).collect()
    if len(some) <= LITERAL:
        by_pointer: dict[str, list[int]] = {}
        for r in some:
            by_pointer.setdefault(r["pointer"], []).append(r["page"])
        either = F.lit(False)
        for pointer, numbers in by_pointer.items():
            either = either | ((F.col("pointer") == pointer) & F.col("page").isin(numbers))
        rows = rows.where(either)
    found = materialize(rows.join(wanted, ["pointer", "page"], "left_semi").dropDuplicates(["pointer", "page"]))
    known = found.where("page = 0").select("pointer", F.lit(True).alias("_known"))
    exact = found.select("pointer", F.col("page").alias("_page"), F.col("data").alias("_data"))
    out = asked.join(known, "pointer", "left").join(exact, ["pointer", "_page"], "left")
    empty = F.lit("").cast("binary")
    data = F.when(F.col("_known"), F.coalesce("_data", empty))
    return out.select(*(asked[c] for c in requests.columns), F.coalesce("_known", F.lit(False)).alias("found"), data.alias("data"))
