"""Conversation structure repair: the cheapest edits that make a conversation an optional system turn and then pairs of
user and assistant.

Every row has a kind: the first letter of its role and its first fault. The edits are a path through four states
(nothing said yet, after the system turn, after a user, after an assistant), and the costs that are left are a vector
over these states. In a segment of a conversation the vectors are computed backward and kept at every square root of its
length alone; walking forward, each block between two of them is computed anew and the tight edit with the
smallest letter is taken. So a segment needs memory for the square root of its rows.

Conversations are cut into segments of SEGMENT rows. What a longer one's segments need of each other are four by four
matrices (least costs from state to state) and maps of states, both combined in trees of FAN children.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .placing import placed

SEGMENT, FAN = 16_384, 256
#: A kind is the place of a role's initial (s, u, a or another) and 0, 4 or 8 for no fault, truncated, or to be deleted.
KINDS = "suaoSUAO0123"
DELETE, INSERT, REROLE, OPEN_END, NEVER = 4, 3, 3, 3, 1 << 50
START, NEXT = 0, (2, 2, 3, 2)  # what follows when the state's next role, user or assistant, is said
#: Costs after the last row: an open user turn or system turn needs one or two more.
AFTER_LAST = (0, 2 * INSERT, INSERT, 0)
BLANKS = " \t\n\x0b\x0c\r"
Vector = tuple[int, int, int, int]


def _says(kind: str) -> tuple[int, int]:
    """State after the row's own role (0 if it has none of the three), and the cost of keeping its text, NEVER if it must go."""
    fault, role = divmod(KINDS.index(kind), 4)
    return (1, 2, 3, 0)[role], (0, OPEN_END, NEVER)[fault]


_SAYS = {k: _says(k) for k in KINDS}


def before(kind: str, after: Vector) -> Vector:
    """Least costs from each state before a row, given those after it."""
    own, text = _SAYS[kind]
    gone = [DELETE + c for c in after]
    if text < NEVER:
        user = text + (0 if own == 2 else REROLE) + after[2]
        assistant = text + (0 if own == 3 else REROLE) + after[3]
        gone = [min(gone[0], user, text + after[1] if own == 1 else NEVER), min(gone[1], user), min(gone[2], assistant), min(gone[3], user)]
    two, three = min(gone[2], INSERT + gone[3]), min(gone[3], INSERT + gone[2])
    return min(gone[0], INSERT + two, NEVER), min(gone[1], INSERT + two, NEVER), min(two, NEVER), min(three, NEVER)


def _step(kind: str, state: int, now: Vector, after: Vector, edits: list[str], roles: list[str]) -> int:
    """The tight edits at a row, smallest letter first, up to the one that takes the row; the state after it."""
    own, text = _SAYS[kind]
    while True:
        least, said = now[state], NEXT[state]
        if DELETE + after[state] == least:
            edits.append("D")
            roles.append("-")
            return state
        if INSERT + now[said] == least:
            edits.append("I")
            roles.append("ua"[said - 2])
            state = said
            continue
        for to in ((1, said) if state == START else (said,)):
            if own == to and text + after[to] == least:
                edits.append("K")
                roles.append("-")
                return to
        edits.append("R")
        roles.append("ua"[said - 2])
        return said


def walk(kinds: str, state: int, end: Vector, last: bool) -> tuple[str, str, int, int]:
    """(edits, roles given by them, state after the rows, cost) of a segment that begins in ``state`` and has ``end`` costs after it."""
    n = len(kinds)
    gap = isqrt(n) + 1
    kept, at = {n: end}, end
    for i in range(n - 1, -1, -1):
        at = before(kinds[i], at)
        if i % gap == 0:
            kept[i] = at
    cost, edits, roles = at[state], [], []
    for first in range(0, n, gap):
        stop = min(first + gap, n)
        block = [kept[stop]]
        for i in range(stop - 1, first - 1, -1):
            block.append(before(kinds[i], block[-1]))
        for i in range(first, stop):
            state = _step(kinds[i], state, block[stop - i], block[stop - i - 1], edits, roles)
    while last and end[state]:
        state = NEXT[state]
        edits.append("I")
        roles.append("ua"[state - 2])
    return "".join(edits), "".join(roles), state, cost


@lru_cache(1 << 14)
def _walk_again(kinds: str, state: int, end: Vector, last: bool) -> tuple[str, str, int, int]:
    """``walk``, for short conversations, many of which are alike."""
    return walk(kinds, state, end, last)


def _pairs_out_of_order(kinds: str, previous: str) -> int:
    said = "".join("suao"[KINDS.index(k) % 4] for k in previous + kinds)
    return sum(said[i : i + 2] not in ("su", "ua", "au") for i in range(len(said) - 1))


def _past(matrix: list[int], costs: list[int]) -> list[int]:
    """Costs before a segment, given those after it and its matrix."""
    return [min(min(matrix[4 * x + y] + costs[y] for y in range(4)), NEVER) for x in range(4)]


def _through(states: list[int], at: list[int]) -> list[int]:
    return [states[at[0]]]


def _matrix(kinds: str) -> list[int]:
    columns = []
    for y in range(4):
        at = tuple(0 if x == y else NEVER for x in range(4))
        for k in reversed(kinds):
            at = before(k, at)
        columns.append(at)
    return [columns[y][x] for x in range(4) for y in range(4)]


def _carried(nodes: DataFrame, backward: bool, start: list[int]) -> DataFrame:
    """(g, seg, value): what reaches each node (g, seg, m) from ``start``, which has passed all nodes after it (or before it).

    A tree: nodes are combined FAN at a time until one is left, and values go down it again.
    """
    past = _past if backward else _through

    def chain(ms: list[list[int]], value: list[int]) -> list[int]:
        for m in ms:
            value = past(m, value)
        return value

    def combined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ms = [list(map(int, m)) for m in rows.sort_values("seg", ascending=not backward)["m"]]
        if backward:
            ends = [chain(ms, [0 if x == y else NEVER for x in range(4)]) for y in range(4)]
            made = [ends[y][x] for x in range(4) for y in range(4)]
        else:
            made = [chain(ms, [s])[0] for s in range(4)]
        return pd.DataFrame({"g": [key[0]], "seg": [key[1]], "m": [made]})

    def spread(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seg", ascending=not backward)
        value, out = list(map(int, rows["value"].iloc[0])), []
        for m in rows["m"]:
            out.append(value)
            value = past(list(map(int, m)), value)
        return pd.DataFrame({"g": rows["g"], "seg": rows["seg"], "value": out})

    above = F.floor(F.col("seg") / FAN).alias("up")
    levels, widest = [nodes], nodes.agg(F.coalesce(F.max("seg"), F.lit(0))).first()[0]
    while widest:
        levels.append(settle(levels[-1].groupBy("g", above).applyInPandas(combined, "g long, seg long, m array<long>")))
        widest //= FAN
    values = levels.pop().select("g", "seg", F.array(*map(F.lit, start)).cast("array<long>").alias("value"))
    while levels:
        parents = values.select("g", F.col("seg").alias("up"), "value")
        below = levels.pop().withColumn("up", F.floor(F.col("seg") / FAN)).join(parents, ["g", "up"])
        values = settle(below.groupBy("g", "up").applyInPandas(spread, "g long, seg long, value array<long>"))
    return values


def _over(rows: DataFrame, schema: str, each: Callable[..., dict]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([each(r) for r in f.itertuples(index=False)], columns=[c.split()[0] for c in schema.split(", ")])

    return rows.mapInPandas(run, schema)


def _planned(segments: DataFrame) -> DataFrame:
    """(g, seg, edits, roles, cost, illegal) of segments (g, seg, n, kinds, previous); cost is that of the whole conversation at seg 0."""
    long = segments.where("n > 1")
    short = segments.where("n = 1").withColumns({"entry": F.lit(START), "end": F.array(*map(F.lit, AFTER_LAST)).cast("array<long>")})
    ways = short
    if not long.isEmpty():
        matrices = settle(_over(long.select("g", "seg", "kinds"), "g long, seg long, m array<long>", lambda r: {"g": r.g, "seg": r.seg, "m": _matrix(r.kinds)}))
        ended = settle(long.join(_carried(matrices, True, list(AFTER_LAST)), ["g", "seg"]).withColumnRenamed("value", "end"))
        passed = lambda r: [walk(r.kinds, s, tuple(map(int, r.end)), False)[2] for s in range(4)]
        maps = settle(_over(ended.select("g", "seg", "kinds", "end"), "g long, seg long, m array<long>", lambda r: {"g": r.g, "seg": r.seg, "m": passed(r)}))
        begun = ended.join(_carried(maps, False, [START]), ["g", "seg"]).withColumn("entry", F.col("value")[0].cast("int")).drop("value")
        ways = short.unionByName(begun)

    def each(r) -> dict:
        way = _walk_again if len(r.kinds) <= 64 else walk
        edits, roles, _, cost = way(r.kinds, int(r.entry), tuple(map(int, r.end)), r.seg == r.n - 1)
        return {"g": r.g, "seg": r.seg, "edits": edits, "roles": roles, "cost": cost, "illegal": _pairs_out_of_order(r.kinds, r.previous or "")}

    return settle(_over(ways, "g long, seg long, edits string, roles string, cost long, illegal long", each))


def _edit_rows(plans: DataFrame, size: int) -> DataFrame:
    """(g, seg, step, edit, to, pos): a row for each edit; pos is the row that it takes, null for an insertion."""
    schema = "g long, seg long, step int, edit string, to string, pos long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, seg, edits, roles in zip(*(batch[c].to_pylist() for c in ("g", "seg", "edits", "roles"))):
                takes = np.frombuffer(edits.encode(), np.uint8) != ord("I")
                pos = pa.array(seg * size + np.cumsum(takes) - takes, pa.int64(), mask=~takes)
                n = len(edits)
                columns = [pa.array(np.full(n, g)), pa.array(np.full(n, seg)), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(edits)), pa.array(list(roles)), pos]
                yield pa.RecordBatch.from_arrays(columns, ["g", "seg", "step", "edit", "to", "pos"])

    return plans.select("g", "seg", "edits", "roles").mapInArrow(run, schema)


def kept_end(text: Column) -> Column:
    """A text without the blanks at its end; empty if it has nothing else."""
    return F.rtrim(text, F.lit(BLANKS))


def repair_conversations(turns: DataFrame, segment: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Report and edits of conversations (conv_id, turn, role, text).

    The report has conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit, a row for each conversation. The
    edits have conv_id, seg, step (their order), edit, turn, role and text, deleted rows included: without them they are the
    repaired conversation.

    Rows go by turn, nulls first; ties by role, then by the SHA-256 of the text, equal rows next to each other. A null
    role or text counts as one space; a null conv_id is a conversation of its own. Roles are known by their first letter
    and keep their whole name when kept. Other columns are ignored; an empty table gives two empty ones.
    """
    size = segment or SEGMENT
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))
    rows = placed(rows.withColumn("h", F.sha2("text", 256)), "conv_id", ["turn", "role", "h"]).withColumnRenamed("_group", "g")
    end, initial = kept_end(F.col("text")), F.instr(F.lit("sua"), F.substring("role", 1, 1))
    flat = rows.select("g", "conv_id", "turn", "role", "h", F.col("_pos").alias("pos"), F.col("_size").alias("size"),
        F.when(F.substring("role", 1, 1) == "", 3).otherwise(F.pmod(initial - 1, F.lit(4))).alias("said"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("open"))
    first = flat.groupBy("g", "role", "h").agg(F.min("pos").alias("pos")).select("g", "pos", F.lit(True).alias("_first"))
    flat = flat.join(first, ["g", "pos"], "left").withColumn("again", ~F.col("blank") & F.col("_first").isNull())
    fault = F.when(F.col("blank") | F.col("again"), 8).when(F.col("open"), 4).otherwise(0)
    flat = settle(flat.select("g", "conv_id", "turn", "pos", "size", "blank", "again", (F.col("open") & ~F.col("blank") & ~F.col("again")).alias("open"),
        F.substring(F.lit(KINDS), F.col("said") + fault + 1, F.lit(1)).alias("kind")))
    seg = F.floor(F.col("pos") / size)
    own = flat.select("g", seg.alias("seg"), F.ceil(F.col("size") / size).alias("n"), F.struct("pos", "kind").alias("at"), F.lit(None).cast("string").alias("before"))
    edges = flat.where((F.col("pos") % size == size - 1) & (F.col("pos") + 1 < F.col("size")))
    edges = edges.select("g", (seg + 1).alias("seg"), F.ceil(F.col("size") / size).alias("n"), F.lit(None).cast("struct<pos: bigint, kind: string>").alias("at"), F.col("kind").alias("before"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["kind"]), "")
    segments = settle(own.unionByName(edges).groupBy("g", "seg").agg(F.first("n").alias("n"), listed.alias("kinds"), F.max("before").alias("previous")))
    plans = _planned(segments)
    whole = plans.groupBy("g").agg(
        F.sum("illegal").alias("illegal"),
        F.max(F.when(F.col("seg") == 0, F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "edits"))), lambda x: x["edits"]), "").alias("audit"),
    )
    counted = flat.groupBy("g", "turn").agg(F.first("conv_id").alias("conv_id"), *(F.count_if(c).alias(c) for c in ("blank", "again", "open")))
    gaps = F.coalesce(F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count("turn"), F.lit(0))
    counted = counted.groupBy("g").agg(F.first("conv_id").alias("conv_id"), gaps.cast("long").alias("gaps"), *(F.sum(c).alias(n) for c, n in (("blank", "blank"), ("again", "duplicate"), ("open", "truncated"))))
    report = counted.join(whole, "g").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    edits = _edit_rows(plans, size)
    given = F.when(F.col("to") == "u", "user").when(F.col("to") == "a", "assistant")
    source = rows.select("g", "conv_id", F.col("_pos").alias("pos"), "turn", "role", "text")
    taken = edits.where("edit <> 'I'").join(source, ["g", "pos"]).select("g", "conv_id", "seg", "step", "edit", "turn", F.coalesce(given, "role").alias("role"), "text")
    named = counted.select("g", "conv_id")
    added = edits.where("edit = 'I'").join(named, "g").select("g", "conv_id", "seg", "step", "edit", F.lit(None).cast("long").alias("turn"), given.alias("role"), F.lit("").alias("text"))
    return report, taken.unionByName(added).drop("g")
