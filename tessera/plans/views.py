"""The operators' input tables as views of the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONVERSATION, Settings

#: Small limits, so that the driver tables put sessions under pressure.
TIGHT = Settings(token_budget=1500, protected_tail_tokens=900, token_limit=2600, batch_slack=100, batch_floor=1200)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("arrival"),
        "text",
        "role",
        F.lit("").alias("cwd"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.lit(None).cast("string").alias("source_id"),
        F.lit(False).alias("generated_summary"),
        "conv_id",
        F.col("turn").cast("int").alias("seq"),
    )


def repeated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn, and every third one again later."""
    once = turns(spark, sf_dir)
    again = once.where("arrival % 3 = 0").withColumn("arrival", F.col("arrival") + 10**9)
    return once.unionByName(again)


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None)
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.lit("default").alias("collection"), F.col("source").alias("source_id"), "text",
        F.lit("").alias("cwd"), F.lit("").alias("session_id"), F.lit("").alias("role"),
    )
    said = turns(spark, sf_dir).where("role in ('user', 'assistant')").select(
        (F.col("arrival") + 10**9).alias("id"), F.lit(CONVERSATION).alias("collection"), F.col("session_id").alias("source_id"), "text", "cwd", "session_id", "role"
    )
    both = docs.unionByName(said)
    return both.withColumns({"sha256": F.sha2("text", 256), "probability": none.cast("double"), "model_version": none.cast("string")})


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("request"))


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation row linked with those one and two turns before, with a made-up probability."""
    rows = turns(spark, sf_dir).where("role in ('user', 'assistant') and seq > 0").select("arrival", "seq", "conv_id")
    each = rows.select("arrival", "seq", "conv_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("back")).where("seq >= back")
    p = (F.col("conv_id") * 31 + F.col("seq") * 17 + F.col("back") * 7) % 100 / 100.0
    return each.select((F.col("arrival") + 10**9).alias("src"), (F.col("arrival") + 10**9 - F.col("back")).alias("dst"), F.lit("related").alias("kind"), p.alias("probability"))


def session_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = turns(spark, sf_dir).select(
        F.col("conv_id").alias("session_id"), "seq", F.concat(F.lit("m"), "seq").alias("id"), "role",
        F.when(F.col("role") == "system", "prefix").otherwise("prose").alias("kind"), F.col("text").alias("content"),
    )
    last = table(spark, sf_dir, "conversations").agg((F.max("conv_id") + 1).alias("n"))
    tools = table(spark, sf_dir, "pages").withColumn("n", last.scalar()).select(
        (F.col("page_id") % F.col("n")).alias("session_id"), (1000 + F.col("page_id")).cast("int").alias("seq"), F.concat(F.lit("call-"), "page_id").alias("id"),
        F.lit("tool").alias("role"), F.lit("tool").alias("kind"), F.col("html").alias("content"),
    )
    return said.unionByName(tools)


def tool_judgments(messages: DataFrame) -> DataFrame:
    """Made-up keep probabilities; one output in 40 is unjudged."""
    page = F.col("seq") - 1000
    rows = messages.where("kind = 'tool'").where(page % 40 != 7)
    return rows.select("session_id", "seq", (page * 37 % 100 / 100.0).alias("probability"))


def entries(messages: DataFrame) -> DataFrame:
    return messages.select(
        "session_id", "seq", F.concat(F.lit("e"), "seq").alias("id"), F.when(F.col("seq") % 2 == 0, "compaction").otherwise("branch_summary").alias("type"),
        F.lit(None).cast("string").alias("message_json"), F.col("content").alias("summary"), F.lit(None).cast("string").alias("content_json"),
    )


def preparation(messages: DataFrame) -> DataFrame:
    sessions = messages.groupBy("session_id").agg(F.min("seq").alias("low"), F.sum(F.length("content")).alias("tokens_before"))
    return sessions.select(
        "session_id",
        F.when(F.col("session_id") % 11 != 5, F.concat(F.lit("e"), "low")).alias("first_kept_entry_id"),
        "tokens_before",
        F.lit(100).alias("reserve_tokens"),
        F.lit(300).alias("keep_recent_tokens"),
        (F.col("session_id") % 7 * 500).cast("int").alias("context_window"),
    )


def plans(messages: DataFrame) -> DataFrame:
    """A made-up plan per session: its first turns, three sessions in four compacted."""
    listed = F.array_sort(F.collect_list(F.struct("seq", "content")))
    rows = messages.where("seq < 3").groupBy("session_id").agg(F.transform(listed, lambda x: x["content"]).alias("context"))
    return rows.withColumn("status", F.when(F.col("session_id") % 4 == 3, "fallback").otherwise("compacted"))
