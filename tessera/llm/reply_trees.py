"""Chat formatting of reply trees: root-to-leaf paths, ranked by score, each written as one conversation with a loss mask.

Paths are found by self-joins that double: after k joins every message knows its 2 ** k-th ancestor and the scores up to
there, so a thread of n messages takes log2(n) joins. Only leaves that are chosen are written out, by the same jumps from
the longest to the shortest. Texts stay out of these joins and meet their path at the end.

A turn is ``<|im_start|>role``, a line break, the text and ``<|im_end|>`` with a line break. In texts and roles a backslash is put into
every ``<``, backslashes, ``|``, so that no control string is left in them; roles escape backslashes and line breaks first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle
from .placing import placed

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PART_TURNS, PART_CHARS = 64, 1 << 22
_STUFFED, _TURN = re.compile(r"<\\(\\*)\|"), re.compile(r"<\|im_start\|>([^\n]*)\n((?:(?!<\|).)*)<\|im_end\|>\n", re.S)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return _STUFFED.sub(r"<\1|", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted part; raises ValueError where it is none."""
    turns, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(found[1]))
        turns.append((role, unescape(found[2])))
        at = found.end()
    return turns


def _jumps(nodes: DataFrame) -> list[DataFrame]:
    """For k = 0, 1, ... (g, n, up, score, far): the 2 ** k-th ancestor (null beyond the root), and sum and number of the scores before it.

    The last table has no ancestor left. ``nodes`` (g, n, up, score, far) are the first; they must not have a cycle.
    """
    found = [nodes]
    while not found[-1].where("up is not null").isEmpty():
        at = found[-1]
        target = at.select("g", F.col("n").alias("up"), F.col("up").alias("_up"), F.col("score").alias("_score"), F.col("far").alias("_far"))
        going = at.where("up is not null").join(target, ["g", "up"])
        going = going.select("g", "n", F.col("_up").alias("up"), (F.col("score") + F.col("_score")).alias("score"), (F.col("far") + F.col("_far")).alias("far"))
        found.append(settle(at.where("up is null").unionByName(going)))
    return found


def _uncycled(nodes: DataFrame) -> DataFrame:
    """Nodes whose cycles are cut: of a cycle's messages the first becomes a root.

    After as many joins as the largest tree can need, whatever still is an ancestor is on a cycle, and the smallest message seen
    on the way round is where it is cut.
    """
    width = nodes.groupBy("g").agg(F.count("*").alias("size")).agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    at, k = settle(nodes.select("g", "n", "up", F.col("n").alias("least"))), 0
    while (1 << k) < width and not at.where("up is not null").isEmpty():
        target = at.select("g", F.col("n").alias("up"), F.col("up").alias("_up"), F.col("least").alias("_least"))
        going = at.where("up is not null").join(target, ["g", "up"])
        going = going.select("g", "n", F.col("_up").alias("up"), F.least("least", "_least").alias("least"))
        at, k = settle(at.where("up is null").unionByName(going)), k + 1
    on = at.where("up is not null").select("g", F.col("up").alias("n")).distinct()
    cut = settle(at.join(on, ["g", "n"], "left_semi").where("n = least").select("g", "n", F.lit(True).alias("_cut")))
    return nodes.join(cut, ["g", "n"], "left").withColumn("up", F.when(F.col("_cut").isNull(), F.col("up"))).drop("_cut")


def format_replies(messages: DataFrame, branches: int | None = None, cycles: bool = True) -> DataFrame:
    """(conv_id, branch, score, part, piece, formatted, loss): the ``branches`` best root-to-leaf paths of each tree, all if None.

    ``messages`` are (conv_id, msg_id, parent_id, role, text, score). A branch's score is the mean of its messages' scores, rounded
    to 9 digits; branch 1 is the best, ties go to the smaller leaf. A conversation is written in parts of at most
    PART_TURNS turns and, beyond one turn, PART_CHARS characters; joined by (part, piece) they are the whole. ``loss`` has
    (begin, end) in characters of ``formatted`` for each assistant text.

    A message without parent, or whose parent is not in its conversation, is a root; a conversation may have several. Messages that
    repeat an id are messages of their own, in order of role and text's SHA-256; replies go to the first. In a cycle the
    smallest message becomes a root (``cycles=False`` says that there is none). Null role and text are empty, a null or NaN
    score is 0, a null conv_id is a conversation. Other columns are ignored; an empty table gives no row.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    scored = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score")
    rows = messages.select("conv_id", "msg_id", "parent_id", empty("role"), empty("text"), scored).withColumn("h", F.sha2("text", 256))
    rows = settle(placed(rows, "conv_id", ["msg_id", "role", "h"]).withColumnsRenamed({"_group": "g", "_pos": "n"}).drop("h", "_size"))
    parents = rows.where("msg_id is not null").groupBy("g", F.col("msg_id").alias("parent_id")).agg(F.min("n").alias("up"))
    replies = rows.where("parent_id is not null").select("g", "n", "parent_id", "score").join(parents, ["g", "parent_id"], "left").select("g", "n", "up", "score")
    roots = rows.where("parent_id is null").select("g", "n", F.lit(None).cast("long").alias("up"), "score")
    nodes = settle(roots.unionByName(replies).withColumn("far", F.lit(1).cast("long")))
    nodes = settle(_uncycled(nodes)) if cycles else nodes
    jumps = _jumps(nodes)
    leaves = jumps[-1].join(nodes.select("g", F.col("up").alias("n")).where("n is not null").distinct(), ["g", "n"], "left_anti")
    leaves = leaves.select("g", "n", F.round(F.col("score") / F.col("far"), 9).alias("score"), (-F.round(F.col("score") / F.col("far"), 9)).alias("worst"))
    chosen = placed(leaves, "g", ["worst", "n"]).select("g", "n", "score", (F.col("_pos") + 1).alias("branch"))
    chosen = settle(chosen if branches is None else chosen.where(F.col("branch") <= branches))
    path = chosen.select("g", "branch", "n")
    for at in reversed(jumps[:-1]):
        further = path.join(at.where("up is not null").select("g", "n", "up"), ["g", "n"]).select("g", "branch", F.col("up").alias("n"))
        path = settle(path.unionByName(further))
    placed_at = jumps[-1].select("g", "n", (F.col("far") - 1).alias("place"))
    turns = path.join(placed_at, ["g", "n"]).join(rows.select("g", "n", "role", "text"), ["g", "n"])
    shown = turns.select("g", "branch", "place", "role", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    shown = shown.select("g", "branch", "place", F.floor(F.col("place") / PART_TURNS).alias("part"), (F.col("role") == "assistant").alias("learned"), F.length("head").alias("skip"), F.length("body").alias("size"),
        F.concat("head", "body", F.lit(CLOSE)).alias("turn"))
    of_part = W.partitionBy("g", "branch", "part")
    so_far = lambda w: F.coalesce(F.sum(F.length("turn")).over(w.orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shown = shown.withColumn("piece", F.floor(so_far(of_part) / PART_CHARS))
    shown = shown.withColumn("begin", so_far(W.partitionBy("g", "branch", "part", "piece")) + F.col("skip"))
    span = F.struct("begin", (F.col("begin") + F.col("size")).alias("end")).alias("span")
    listed = F.array_sort(F.collect_list(F.struct("place", "learned", span, "turn")))
    parts = shown.groupBy("g", "branch", "part", "piece").agg(listed.alias("l"))
    parts = parts.select("g", "branch", "part", "piece", F.array_join(F.transform("l", lambda x: x["turn"]), "").alias("formatted"),
        F.transform(F.filter("l", lambda x: x["learned"]), lambda x: x["span"]).alias("loss"))
    named = rows.groupBy("g").agg(F.first("conv_id").alias("conv_id"))
    of = chosen.select("g", "branch", "score").join(named, "g")
    return parts.join(of, ["g", "branch"]).select("conv_id", "branch", "score", "part", "piece", "formatted", "loss")


def threads(turns: DataFrame) -> DataFrame:
    """Messages of conversations (conv_id, turn, role, text) in which every row answers the one before it.

    Rows go by turn, nulls first, ties by role and the text's SHA-256.
    """
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    at = placed(rows, "conv_id", ["turn", "role", "h"])
    parent = F.when(F.col("_pos") > 0, F.col("_pos") - 1)
    return at.select("conv_id", F.col("_pos").alias("msg_id"), parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
