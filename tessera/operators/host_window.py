"""The host's side of compaction: where to cut a session log, and what stands for the cut part.

entries: session_id, seq, id, type, message_json, summary, content_json. preparation: session_id,
first_kept_entry_id, tokens_before, reserve_tokens, keep_recent_tokens, context_window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.text import entry_tokens, estimate_tokens_utf16
from .messages import _prepared, messages_from_preparation


def host_budget(preparation: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(session_id, budget): the window less the reserve, else what to keep."""
    reserve = F.coalesce("reserve_tokens", F.lit(settings.reserve_tokens))
    keep = F.coalesce("keep_recent_tokens", F.lit(settings.keep_recent_tokens))
    budget = F.when(F.col("context_window") > reserve, F.col("context_window") - reserve).otherwise(keep)
    return preparation.select("session_id", budget.cast("long").alias("budget"))


def suffix_from(entries: DataFrame, firsts: DataFrame) -> DataFrame:
    """Entries from the first one whose id is its session's first_id; none where that is absent."""
    rows = entries.join(firsts.where("first_id <> ''").select("session_id", "first_id"), "session_id")
    start = F.min(F.when(F.col("id") == F.col("first_id"), F.col("seq"))).over(W.partitionBy("session_id"))
    return rows.withColumn("_start", start).where("seq >= _start").drop("_start", "first_id")


def _suffix_tokens(suffix: DataFrame) -> DataFrame:
    return suffix.groupBy("session_id").agg(F.sum(entry_tokens(suffix)).alias("suffix_tokens"))


def select_fresh_cut(entries: DataFrame, budgets: DataFrame) -> DataFrame:
    """(session_id, first_kept, kept_tokens): the longest suffix that fits with the summary.

    budgets: session_id, summary_tokens, budget. Entries without an id are left out.
    """
    rows = entries.where("id <> ''").withColumn("cost", entry_tokens(entries)).select("session_id", "seq", "id", "cost")
    limits = budgets.select("session_id", "budget", F.greatest(F.coalesce("summary_tokens", F.lit(0)), F.lit(0)).alias("summary"))
    run = F.sum("cost").over(W.partitionBy("session_id").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, W.currentRow))
    fits = rows.withColumn("run", run).join(limits, "session_id").where("budget > 0 and summary <= budget and summary + run <= budget")
    cut = fits.groupBy("session_id").agg(F.min_by("id", "seq").alias("first_kept"), F.max("run").alias("kept_tokens"))
    return limits.select("session_id").join(cut, "session_id", "left").withColumn("kept_tokens", F.coalesce("kept_tokens", F.lit(0)))


def _firsts(preparation: DataFrame, name: str = "first_kept_entry_id") -> DataFrame:
    return preparation.select("session_id", F.col(name).alias("first_id"))


def deepened_cut(preparation: DataFrame, entries: DataFrame, summary_tokens: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(session_id, cut): the preferred cut if all fits, else a later one, else the fresh window."""
    allowance = settings.summary_allowance if summary_tokens is None else summary_tokens
    suffix = suffix_from(entries, _firsts(preparation))
    limits = host_budget(preparation, settings).withColumn("summary_tokens", F.lit(allowance))
    later = select_fresh_cut(suffix, limits)
    rows = preparation.join(limits, "session_id").join(_suffix_tokens(suffix), "session_id", "left").join(later, "session_id", "left")
    whole = F.lit(allowance) + F.coalesce("suffix_tokens", F.lit(0)) <= F.col("budget")
    return rows.select("session_id", F.when(whole, F.col("first_kept_entry_id")).otherwise(F.coalesce("first_kept", F.lit(settings.window_id))).alias("cut"))


def messages_for_compaction(preparation: DataFrame, entries: DataFrame, cuts: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The preparation's messages, then the message entries between the preferred cut and the new one."""
    base = messages_from_preparation(preparation)
    moved = preparation.join(cuts, "session_id").where("cut <> '' and not (cut <=> first_kept_entry_id)")
    suffix = suffix_from(entries, _firsts(moved)).join(moved.select("session_id", "cut"), "session_id")
    at = F.min(F.when(F.col("id") == F.col("cut"), F.col("seq"))).over(W.partitionBy("session_id"))
    # an unknown cut drops nothing; the fresh window drops the whole suffix
    dropped = suffix.withColumn("_at", at).where((F.col("cut") == settings.window_id) | (F.col("seq") < F.col("_at")))
    dropped = dropped.where("type = 'message' and message_json is not null")
    nth = F.row_number().over(W.partitionBy("session_id").orderBy("seq")) - 1
    extra = _prepared(dropped.select("session_id", nth.alias("seq"), F.col("message_json").alias("m")))
    return base.withColumn("part", F.lit(0)).unionByName(extra.withColumn("part", F.lit(1)))


def fit_summary(summary: Column, budget: Column) -> Column:
    """Leading parts of a summary, parted by blank lines, while they fit; the whole if it fits."""
    parts = F.split(summary, "\n\n")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(True).alias("open"), F.lit(0).alias("n"))

    def step(acc: Column, part: Column) -> Column:
        used = acc["used"] + estimate_tokens_utf16(part) + F.when(acc["n"] > 0, 1).otherwise(0)
        more = acc["open"] & (used <= budget)
        return F.struct(F.when(more, used).otherwise(acc["used"]).cast("long").alias("used"), more.alias("open"), (acc["n"] + more.cast("int")).alias("n"))

    kept = F.array_join(F.slice(parts, F.lit(1), F.aggregate(parts, start, step, lambda a: a["n"])), "\n\n")
    return F.when(F.coalesce(summary, F.lit("")) == "", "").when(estimate_tokens_utf16(summary) <= budget, summary).otherwise(kept)


def plan_summary() -> Column:
    return F.when(F.col("status") == "compacted", F.array_join("context", "\n\n")).otherwise("")


def plan_compaction(preparation: DataFrame, entries: DataFrame, plans: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """(session_id, summary, first_kept_entry_id, tokens_before, fresh_cut) of sessions that are compacted."""
    suffix = suffix_from(entries, _firsts(preparation))
    rows = preparation.join(host_budget(preparation, settings), "session_id").join(plans.select("session_id", "status", "context"), "session_id", "left")
    rows = rows.withColumn("summary", fit_summary(F.coalesce(plan_summary(), F.lit("")), F.col("budget")))
    rows = rows.join(_suffix_tokens(suffix), "session_id", "left").withColumn("suffix_tokens", F.coalesce("suffix_tokens", F.lit(0)))
    size = estimate_tokens_utf16(F.col("summary"))
    line = estimate_tokens_utf16(F.lit(settings.window_line))
    rows = rows.withColumns({"over": size + F.col("suffix_tokens") > F.col("budget"), "summary_tokens": F.when(size > 0, size).otherwise(line)})
    later = select_fresh_cut(suffix, rows.select("session_id", "summary_tokens", "budget"))
    rows = rows.join(later.withColumnRenamed("kept_tokens", "later_tokens"), "session_id", "left")
    preferred = F.col("first_kept_entry_id")
    rows = rows.withColumns(
        {
            "kept_id": F.when(F.col("over"), F.coalesce("first_kept", F.lit(settings.window_id))).otherwise(preferred),
            "summary": F.when(F.col("over") & (F.col("summary") == ""), settings.window_line).otherwise(F.col("summary")),
            "tail": F.when(~F.col("over"), F.col("suffix_tokens")).when(F.col("first_kept").isNull(), 0).otherwise(_tail_tokens()),
        }
    )
    room = F.greatest(F.col("budget") - F.col("tail"), F.lit(0))
    refit = F.coalesce(F.nullif(fit_summary(F.col("summary"), room), F.lit("")), F.lit(settings.window_line))
    summary = F.when(estimate_tokens_utf16(F.col("summary")) + F.col("tail") > F.col("budget"), refit).otherwise(F.col("summary"))
    rows = rows.where("summary <> '' and kept_id <> ''")
    return rows.select("session_id", summary.alias("summary"), F.col("kept_id").alias("first_kept_entry_id"), "tokens_before", (~F.col("kept_id").eqNullSafe(preferred)).alias("fresh_cut"))


def _tail_tokens() -> Column:
    return F.col("later_tokens")


def compaction_from_plan(plans: DataFrame, preparation: DataFrame) -> DataFrame:
    """Compacted plans with a context as their joined summary."""
    rows = plans.where("status = 'compacted' and size(context) > 0").join(preparation, "session_id")
    return rows.select("session_id", F.array_join("context", "\n\n").alias("summary"), "first_kept_entry_id", "tokens_before", "estimator", "over_budget")
