"""Full-text index and BM25 retrieval for many requests at once.

Postings are bucketed by passage, so counting, scoring and the first top-k need no exchange: the set of all
(passage, request) matches is never shuffled. The query side is broadcast in slices of a bounded number of tokens;
requests of more than that are scored in cells (cells.py). Without an index only the asked tokens are counted, and requests go to
the texts.

An index is (postings, token_df, corpus_stats), which build_index makes for a session, or a BlockIndex (blocks.py), whose
shortlists read few postings; kept_index.py keeps one under a path.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.bm25 import bm25_idf, bm25_score
from ..functions.text import query_tokens
from ..sources.shared import materialize, shared_dir
from .blocks import BlockIndex, top_matches
from .cells import best_in_cells, best_in_place, best_in_slices, hashed
from .counted import count_asked, count_heads, count_lists, count_tokens

SLICE_TOKENS, MAX_SLICES = 200_000, 1
Index = tuple[DataFrame, DataFrame, DataFrame] | BlockIndex


def _counted(memory: DataFrame, text: str, buckets: int) -> DataFrame:
    """Counts of each id's tokens. Texts are dealt by id before they are cut; a count by id and token follows only where ids repeat."""
    counted = count_tokens(memory.select("id", F.col(text).alias("text")).repartition(buckets, "id"))
    return _by_id(counted) if _repeats(memory) else counted


def _repeats(rows: DataFrame) -> bool:
    return not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _by_id(counted: DataFrame, *keep: str) -> DataFrame:
    others = [F.max(c).alias(c) for c in keep]
    return counted.groupBy("id", "token").agg(F.sum("tf").cast("int").alias("tf"), F.first("doc_len").alias("doc_len"), *others)


def build_index(memory: DataFrame, text: str = "text") -> Index:
    """postings (id, token, tf, doc_len), token_df (token, df) and corpus_stats (n_docs, avg_len), over all collections.

    Texts are tokenised once; the postings are written to the shared folder, a bucket for each shuffle partition.
    """
    spark = memory.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"postings_{uuid.uuid4().hex}"
    counted = _counted(memory, text, buckets).select("id", "token", "tf", "doc_len")
    counted.write.format("parquet").bucketBy(buckets, "id").options(compression="zstd", path=f"{shared_dir(spark)}/tables/{name}").saveAsTable(name)
    postings = spark.table(name)
    token_df = materialize(postings.groupBy("token").agg(F.count("*").alias("df")))
    length = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"))
    stats = memory.agg(F.count("*").alias("n_docs")).withColumn("avg_len", length.scalar() / F.nullif(F.col("n_docs"), F.lit(0)))
    return postings, token_df, materialize(stats)


def _shortlist_in_place(asked: DataFrame, memory: DataFrame, limit: int, collection: str | None, before_self: bool, max_df_ratio: float | None, settings: Settings) -> DataFrame:
    """The shortlist of a bounded list of requests' tokens (request_id, word, mult), which goes to the texts.

    Texts are cut where they are read and leave a row with the counts of their asked tokens, which are scored where they are written.
    Frequencies and lengths are those of all passages.
    """
    spark = memory.sparkSession
    known = asked.toArrow()  # SLICE_TOKENS rows at most, as a broadcast side
    words = pc.unique(known["word"])
    inside = F.lit(True) if collection is None else F.coalesce(F.col("collection") == collection, F.lit(False))
    rows = memory.select("id", inside.alias("inside"), "text")
    if rows.select(F.spark_partition_id().alias("p")).distinct().count() < spark.sparkContext.defaultParallelism:  # a few large files
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    passages = materialize(count_asked(rows, words, keep=("id", "inside")))
    n_docs, length = passages.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    repeats = _repeats(passages)
    if repeats:
        each = passages.select("id", "inside", "doc_len", F.inline(F.arrays_zip("tokens", "tfs"))).withColumnsRenamed({"tokens": "token", "tfs": "tf"})
        each = materialize(_by_id(each, "inside"))
    heads = (each if repeats else passages.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count("*").alias("df"))
    heads = heads.select("token", bm25_idf(F.lit(n_docs), F.col("df")).alias("idf"))
    heads = heads if max_df_ratio is None else heads.where(F.col("idf") >= math.log(1 / max_df_ratio - 1))
    places = pa.table({"word": words, "token": pa.array(range(len(words)), pa.int32())})
    found = known.join(places, "word", join_type="inner").join(heads.toArrow(), "token", join_type="inner")
    found = found.append_column("avg_len", pa.array([length / max(n_docs, 1)] * len(found), pa.float64()))
    if repeats:
        postings = each.where("inside").select(F.col("token").cast("long").alias("token"), "id", "tf", F.col("doc_len").alias("len"))
        return best_in_cells(spark.createDataFrame(found).withColumn("token", F.col("token").cast("long")), postings, limit, before_self, settings)
    found = found.append_column("weight", pc.multiply(found["idf"], pc.cast(found["mult"], pa.float64())))
    sides = found.select(["request_id", "token", "weight", "avg_len"]).group_by("request_id").aggregate([("token", "list"), ("weight", "list"), ("avg_len", "max")])
    sides = sides.select(["request_id", "token_list", "weight_list", "avg_len_max"]).rename_columns(["request_id", "ts", "weights", "avg_len"])
    return best_in_place(sides, passages.where("inside"), limit, before_self, settings)


def _shortlist_in_slices(asked: DataFrame, memory: DataFrame, limit: int, collection: str | None, before_self: bool, settings: Settings) -> DataFrame:
    """The shortlist of very many requests' tokens (request_id, word, mult) among passages whose ids occur once.

    Texts are cut where they are read: for the frequencies, of which a task returns one a token, and those of the collection again for
    their tokens, a row a passage.
    """
    spark = memory.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = lambda rows: rows.repartition(parts, "id") if rows.select(F.spark_partition_id().alias("p")).distinct().count() < spark.sparkContext.defaultParallelism else rows
    heads = materialize(count_heads(dealt(memory.select("id", "text"))))
    length = heads.where("token is null").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    n_docs = memory.count()
    known = asked.join(heads.withColumnRenamed("token", "word"), "word").withColumn("avg_len", F.lit(length / max(n_docs, 1)))
    known = known.select("request_id", F.col("word").alias("token"), "mult", bm25_idf(F.lit(n_docs), F.col("df")).alias("idf"), "avg_len")
    inside = memory if collection is None else memory.where(F.col("collection") == collection)
    lists = count_lists(inside.select("id", "text").repartition(parts, "id"))
    return best_in_slices(known, lists.withColumn("tokens", F.transform("tokens", hashed)), limit, before_self, settings)


def _query_side(requests: DataFrame, index: Index, settings: Settings) -> DataFrame:
    """(request_id, token, mult, idf, avg_len): repeated tokens are folded into ``mult``."""
    postings, token_df, stats = index
    tokens = requests.select("request_id", F.explode(query_tokens(F.col("request"), settings)).alias("token"))
    counted = tokens.groupBy("request_id", "token").agg(F.count("*").alias("mult"))
    known = counted.join(token_df, "token")
    known = known.withColumns({"n_docs": stats.select("n_docs").scalar(), "avg_len": stats.select("avg_len").scalar()})
    return known.select("request_id", "token", "mult", bm25_idf(F.col("n_docs"), F.col("df")).alias("idf"), "avg_len")


def shortlist(
    requests: DataFrame,
    memory: DataFrame,
    limit: int | None = None,
    collection: str | None = None,
    index: Index | None = None,
    before_self: bool = False,
    max_df_ratio: float | None = None,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """(request_id, id, score, rank): rows that match any query token, best first, ties by id.

    ``before_self`` keeps rows with an id below the request's alone. ``max_df_ratio`` leaves out tokens in a
    larger share of the rows; it is faster and can miss matches, so it is off by default.
    """
    limit = settings.shortlist_limit if limit is None else limit
    if isinstance(index, BlockIndex):
        if max_df_ratio is not None:
            raise ValueError("a block index leaves no token out")
        return top_matches(requests, index, limit, collection, before_self, settings=settings)
    if index is None:
        words = requests.select("request_id", F.explode(query_tokens(F.col("request"), settings)).alias("word"))
        words = materialize(words.groupBy("request_id", "word").agg(F.count("*").alias("mult")))
        tokens = words.agg(F.sum("mult")).first()[0] or 0
        if tokens <= SLICE_TOKENS * MAX_SLICES:
            return _shortlist_in_place(words, memory, limit, collection, before_self, max_df_ratio, settings).select("request_id", "id", "score", "rank")
        if max_df_ratio is None and not _repeats(memory):
            return _shortlist_in_slices(words, memory, limit, collection, before_self, settings).select("request_id", "id", "score", "rank")
    else:
        tokens = requests.select(F.sum(F.least(F.size(query_tokens(F.col("request"), settings)), F.lit(settings.max_query_tokens)))).first()[0] or 0
    slices = max(1, math.ceil(tokens / SLICE_TOKENS))
    index = index or build_index(memory)
    postings, asked = index[0], _query_side(requests, index, settings)
    if max_df_ratio is not None:
        asked = asked.where(F.col("idf") >= math.log(1 / max_df_ratio - 1))
    if collection is not None:
        inside = memory.where(F.col("collection") == collection).select("id")
        postings = postings.join(inside, "id", "left_semi")
    if slices > MAX_SLICES and max_df_ratio is None:  # matches grow with requests times passages; cells don't shuffle them
        return best_in_cells(asked, postings.withColumnRenamed("doc_len", "len"), limit, before_self, settings).select("request_id", "id", "score", "rank")
    order = W.partitionBy("request_id").orderBy(F.desc("score"), "id")

    def one(s: int) -> DataFrame:
        part = asked if slices == 1 else asked.where(F.pmod(F.xxhash64("request_id"), F.lit(slices)) == s)
        hits = postings.join(F.broadcast(part), "token")  # SLICE_TOKENS rows, about, at most
        hits = hits.where("id < request_id") if before_self else hits
        parts = bm25_score(F.col("tf"), F.col("doc_len"), F.col("avg_len"), F.col("idf"), settings) * F.col("mult")
        scored = hits.groupBy("id", "request_id").agg(F.round(F.sum(parts), 9).alias("score"))
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)

    return reduce(DataFrame.unionByName, [one(s) for s in range(slices)]).select("request_id", "id", "score", "rank")
