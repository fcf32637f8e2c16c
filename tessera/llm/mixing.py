"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed into cells of source, language and topic. The cells' weights are raked to the
marginals of each dimension in turn until none is off by more than ``tolerance``; a document is then kept
with the probability of its cell. A budget says which share of the tokens is kept: a cell that has less than
its part of it is kept whole (probability 1), and what it leaves goes to the others in proportion to their
weights, so no odd cell decides how much of the corpus stays. The draw is a hash of doc_id, so it is the same
on every run and cluster.

The table of cells is Spark's throughout: each step of a sweep is an aggregate per value of a dimension and a
join back, so many sources are no burden on the driver and few topics no bottleneck; lineage is cut after
each sweep.

Defined cases: a null source, language or topic is the value ``unknown``; a null or empty text counts no
token, belongs to its cell and is drawn by the cell's probability; a target for a value that the corpus
lacks is left out and the rest rescaled; a value without a target has the target 0 and is not kept; without
targets for a dimension, values get the root of their present share (rescaled); without any targets the budget
is ``TOKEN_BUDGET``; with targets and no budget as much is kept as meets the targets exactly; targets that no
weights can meet leave a gap, which is returned and warned of; repeated ids share their draw and a null id is
never kept; empty input gives empty output; further columns are kept, but for weight, probability, kept and the
cell's three (``_source``, ``_lang``, ``_topic``), which are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, utf8_slices

#: Topics by the first of their phrases found anywhere in a text, else prose.
TOPIC_PHRASES = (
    ("legal", ("Licensed under", "All rights reserved", "Copyright")),
    ("table", (" | ",)),
    ("symbols", ("***", "###", "&&&", "%%%", "$$$")),
    ("contact", ("@", "http://", "https://")),
)
DIMENSIONS = ("source", "lang", "topic")
#: Fixed value: the share of the tokens that is kept where neither targets nor a budget are given.
TOKEN_BUDGET = 0.8


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, phrases in reversed(TOPIC_PHRASES):
        has = F.lit(False)
        for phrase in phrases:
            has = has | text.contains(phrase)
        out = F.when(has, name).otherwise(out)
    return out


def token_counts(text: pa.Array) -> np.ndarray:
    """Words of each text, 0 for null."""
    out = np.zeros(len(text), np.int64)
    for first, last, raw, off in utf8_slices(text):
        solid = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        begins = solid.copy()
        inner = np.ones(len(raw) + 1, bool)
        inner[off] = False
        begins[1:] &= ~(solid[:-1] & inner[1 : len(raw)])
        out[first:last] = np.diff(np.r_[0, np.cumsum(begins)][off])
    return out


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """Add the cell of each document, under names that start with an underscore.

    The topic is the given one, else the input's own column ``topic``, else that of TOPIC_PHRASES.
    """
    if topic is None:
        topic = F.col("topic") if "topic" in docs.columns else topic_of(F.col("text"))
    known = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic}
    return docs.withColumns({f"_{d}": F.coalesce(c.cast("string"), F.lit("unknown")) for d, c in known.items()})


def cell_tokens(dealt: DataFrame) -> DataFrame:
    """Tokens of each cell; texts go to Python once and do not come back."""
    names = [f"_{d}" for d in DIMENSIONS]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(token_counts(batch["text"]))], [*names, "_tokens"])

    counted = dealt.select(*names, "text").mapInArrow(count, ", ".join(f"{n} string" for n in names) + ", _tokens long")
    return counted.groupBy(names).agg(F.sum("_tokens").alias("_tokens"))


def _targets(cells: DataFrame, dim: str, given: Mapping[str, float] | None) -> DataFrame:
    """Per value of a dimension the share that it should have; shares sum to 1 over values present."""
    spark, present = cells.sparkSession, cells.groupBy(f"_{dim}").agg(F.sum("_tokens").alias("n")).where("n > 0")
    if given is None:
        raw = present.select(f"_{dim}", F.sqrt("n").alias("share"))
    else:
        rows = [(k, float(v)) for k, v in given.items() if v > 0] or [("", 0.0)]
        raw = present.join(spark.createDataFrame(rows, f"_{dim} string, share double"), f"_{dim}").select(f"_{dim}", "share")
    total = raw.agg(F.sum("share").alias("all_shares"))
    return raw.withColumn("all_shares", total.scalar()).select(f"_{dim}", (F.col("share") / F.col("all_shares")).alias(f"share_{dim}"))


def _level(cells: DataFrame) -> float:
    """The level at which least(level * part, supply) of the cells sum to 1, or all supply is used.

    The sum is concave in the level and made of straight pieces, so steps of Newton's method from below end on it.
    """
    level = 0.0
    while True:
        at = F.col("weight") * level
        full = at >= F.col("supply")
        got, left = cells.agg(F.sum(F.when(full, F.col("supply")).otherwise(at)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not left or 1 - got <= 1e-12:
            return level
        level += (1 - got) / left


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, tolerance: float = 1e-6, max_sweeps: int = 100) -> DataFrame:
    """Cells (_source, _lang, _topic, _tokens) with ``weight``, their raked share of the tokens, and ``gap``.

    The gap is by how much the worst marginal is off. Empty cells can make targets conflict; then the fit after
    ``max_sweeps`` is returned, with its gap.
    """
    targets = targets or {}
    fitted = cells.where("_tokens > 0").withColumn("weight", F.col("_tokens").cast("double"))
    for d in DIMENSIONS:
        fitted = fitted.join(_targets(cells, d, targets.get(d)), f"_{d}")
    total = fitted.agg(F.sum("weight").alias("whole"))
    fitted = settle(fitted.withColumn("weight", F.col("weight") / total.scalar()))
    columns, gap = fitted.columns, 0.0
    for _ in range(max_sweeps):
        for d in DIMENSIONS:
            margin = fitted.groupBy(f"_{d}").agg(F.sum("weight").alias("margin"))
            fitted = fitted.join(margin, f"_{d}").withColumn("weight", F.col("weight") * F.try_divide(F.col(f"share_{d}"), F.col("margin"))).select(columns)
        fitted = settle(fitted)  # plans of several sweeps take far longer
        margins = [fitted.groupBy(f"_{d}").agg(F.abs(F.sum("weight") - F.max(f"share_{d}")).alias("off")).agg(F.max("off").alias("off")) for d in DIMENSIONS[:-1]]
        gap = margins[0].unionByName(margins[1]).agg(F.max("off")).first()[0] or 0.0  # the last dimension was met just now
        if gap <= tolerance:
            break
    return fitted.select([f"_{d}" for d in DIMENSIONS] + ["weight", F.lit(gap).alias("gap")])


def mix_sources(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, seed: int = 17, budget: float | None = None, topic: Column | None = None, **rake_options
) -> DataFrame:
    """Every document with its cell's weight, its probability and whether it is ``kept``.

    The probability of a cell is its weight over its tokens, scaled so that the budget (a share of the tokens that
    have targets) is kept, or without one so that the largest is 1; no document is repeated.
    """
    budget = TOKEN_BUDGET if budget is None and not targets else budget
    dealt = with_cells(docs.drop("weight", "probability", "kept"), topic)
    names = [f"_{d}" for d in DIMENSIONS]
    cells = settle(cell_tokens(dealt))
    weights = rake(cells, targets, **rake_options)
    rates = settle(cells.join(weights, names, "left").withColumn("rate", F.try_divide("weight", F.col("_tokens").cast("double"))))
    gap, fastest, whole = rates.agg(F.max("gap"), F.max("rate"), F.sum(F.when(F.col("weight") > 0, F.col("_tokens")))).first()
    if gap is not None and gap > rake_options.get("tolerance", 1e-6):
        warnings.warn(f"the targets conflict: a marginal is off by {gap:.2g}", stacklevel=2)
    if not fastest:
        scale = 0.0
    elif budget is None:
        scale = 1 / fastest
    else:
        wanted = whole * min(budget, 1.0)
        supply = rates.where("weight > 0").select("weight", (F.col("_tokens") / F.lit(wanted)).alias("supply"))
        scale = _level(supply) * wanted
    probability = F.least(F.coalesce(F.col("rate") * scale, F.lit(0.0)), F.lit(1.0))
    rates = rates.select(*names, F.coalesce("weight", F.lit(0.0)).alias("weight"), probability.alias("probability"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) / float(1 << 52)
    joined = dealt.join(rates, names, "left")
    return joined.withColumn("kept", F.coalesce(F.col("doc_id").isNotNull() & (draw < F.col("probability")), F.lit(False)))
