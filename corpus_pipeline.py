"""The corpus pipeline: toxic documents go, repeated lines go, one of each near-duplicate group stays, sources
are mixed to target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept. All but the last
return the columns of documents. The toxicity model is learned from the labelled rows of the input tables.

Defined cases: documents with a null text or id are kept until the mix, which draws by id and cell; a
document that loses all its lines goes; empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import line_dedup, mixing, ngram_join, pieces, toxicity
from tessera.llm.common import settle, table
from tessera.llm.queries import learned_toxicity, piece_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; texts that are null or empty score the intercept and stay."""
    return toxicity.score_toxicity(docs.select(*COLUMNS), learned_toxicity(spark, sf_dir), drop_from=0.5).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has are cut; a document that loses lines and has no word left goes."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    left = cut.where("n_removed = 0 or length(trim(text)) > 0")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8, the smallest doc_id stays; of rows that repeat an id, one.

    Rows without an id or without a word are linked with nothing; equal ones are one row.
    """
    later = ngram_join.link_similar(docs, k=5, percent=80).where("component_id <> doc_id").select("doc_id")
    left = docs.join(later, "doc_id", "left_anti").select(*COLUMNS)
    named, unnamed = (left.where(f"doc_id is {x} null") for x in ("not", ""))
    return named.dropDuplicates(["doc_id"]).unionByName(unnamed.dropDuplicates())


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, raked towards even sources, languages and topics; a document without an id goes."""
    return mixing.mix_sources(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's piece ids; a null text has null ids, an empty one none."""
    encoded = pieces.encode(docs.select("doc_id", "text", "lang", "source"), piece_model())
    return encoded.select("doc_id", "lang", "source", pieces.count_ids(F.col("ids")).alias("n_ids"), "ids")


STAGES = [
    ("toxicity", toxic_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL expresses neither the classifier nor the alignment, the mix or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
