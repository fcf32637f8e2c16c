"""Line dedup by pairwise alignment.

Lines are separated by a newline; lines of white space alone are blank and are passed over. A window is a shortest run of
other lines that has ``min_block_chars`` characters from its first line on, or up to its last line. So every block of that
size that two documents share is covered by windows that they share. A window's key is the hash of its lines and
how often the document had the same before, so that a key is unique in its document and a document that repeats itself
is aligned too. A window that its document repeats has a second key with the two lines around it, so that a
repeat within a passage is met wherever the passage stands.

Documents that share a key overlap: each later holder is paired with the first one (the smallest doc_id), so a window
in n documents makes n - 1 pairs and not n * n. What two documents share is not lost by that: each of their windows
meets its own first holder, whoever that is, and is large enough to go alone. A pair is aligned by patience diff: of
the shared keys that are rare in the corpus (at most ``rare_docs`` documents) the longest run that rises in both
documents, then in the gaps the same for the frequent ones; a pair without rare keys is aligned by its frequent ones.
Matched windows that follow one another in both documents are a block, which goes from the later document.
Decisions are taken on the input, so a block always stays in its first document.

Only shared windows go to a pair (one small row each), whatever the length of the first document, and texts move
once, to meet the lines that leave them. Keys of more than 1/4096 of all windows are at most 4096 and are joined
by broadcast, so a line that is everywhere lands in no single task.

Defined cases: doc_id is an integer; a null text has no lines and stays null; an empty text has one (blank) line; blank
lines go only within a block; texts of fewer than ``min_block_chars`` characters are never paired; a null doc_id is never
paired; rows that repeat a doc_id are not compared with each other, and equal ones lose the same lines; empty tables give
empty results; further columns stay, but for n_lines and n_removed, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, join_hot, settle, utf8_slices
from .words import _tables, mix, words

MIN_BLOCK_CHARS = 40
RARE_DOCS = 100
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PLACES = ("pos", "lo", "hi", "from_line", "to_line", "chars_to", "chars_past")


def _numbered(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often the row had a code before, and whether it has it more than once."""
    order = np.lexsort((code, row))
    new = np.ones(len(order), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (code[order][1:] != code[order][:-1])
    edge = np.flatnonzero(new)
    size = np.diff(np.r_[edge, len(order)])
    nth, many = np.empty(len(order), np.int64), np.empty(len(order), bool)
    nth[order] = np.arange(len(order)) - np.repeat(edge, size)
    many[order] = np.repeat(size > 1, size)
    return nth, many


def line_keys(column: pa.Array, least: int) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """For runs of rows: the row of each key, and the columns key and _PLACES.

    A window covers the lines that are not blank from ``lo`` to before ``hi``, which are the lines ``from_line`` to before
    ``to_line``; ``chars_to`` and ``chars_past`` count characters up to there. Windows of a document never hold one
    another, so ``pos``, the sum of both ends, tells them apart and puts them in order.
    """
    for first, _, raw, off in utf8_slices(column):
        start, end, row, code = words(raw, off, raw != 10)
        solid = np.r_[0, np.cumsum(~_BLANK[raw])]
        full = solid[end] > solid[start]
        start, end, row, code = start[full], end[full], row[full], code[full]
        n = len(start)
        if not n:
            continue
        breaks, letters = np.r_[0, np.cumsum(raw == 10)], np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        number = breaks[start] - breaks[off[row]]
        before = np.r_[0, np.cumsum(letters[end] - letters[start])]
        low, high = np.searchsorted(row, row), np.searchsorted(row, row, "right")
        at = np.arange(n)
        last, first_of = np.searchsorted(before, before[:-1] + least), np.searchsorted(before, before[1:] - least, "right") - 1
        ahead, behind = last <= high, first_of >= low
        window = np.unique(np.r_[at[ahead] * (n + 1) + last[ahead], first_of[behind] * (n + 1) + at[behind] + 1])
        if not len(window):
            continue
        lo, hi = window // (n + 1), window % (n + 1)
        own, low, high = row[lo], low[lo], high[lo]
        up, down = _tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(code * up[:n], out=sums[1:])
            run = mix((sums[hi] - sums[lo]) * down[lo])
            nth, many = _numbered(own, run)
            key = mix(run + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            m = np.flatnonzero(many)
            left = np.where(lo[m] > low[m], code[np.maximum(lo[m] - 1, 0)], np.uint64(1))
            right = np.where(hi[m] < high[m], code[np.minimum(hi[m], n - 1)], np.uint64(2))
            around = mix(run[m] + mix(left + np.uint64(3)) * np.uint64(5) + mix(right + np.uint64(7)) * np.uint64(11))
            key = np.r_[key, mix(around + _numbered(own[m], around)[0].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))]
        at = np.r_[np.arange(len(lo)), m]
        base, lo, hi = low[at], lo[at], hi[at]
        places = (lo + hi - 2 * base, lo - base, hi - base, number[lo], number[hi - 1] + 1, before[lo] - before[base], before[hi] - before[base])
        yield first + own[at], {"key": key.view(np.int64)} | {name: x.astype(np.int32) for name, x in zip(_PLACES, places)}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of their first part (equal ones by falling second part), that rises in both."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(tops, b)
        back.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[at], piles[at] = b, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(pairs: list[tuple[int, int, bool]]) -> list[tuple[int, int]]:
    """The aligned of the places (later, first, rare) of two documents' shared keys: rare ones, then the gaps."""
    pairs = sorted(pairs, key=lambda p: (p[0], -p[1]))
    anchors = [(-1, -1), *_rising([p[:2] for p in pairs if p[2]])]
    gaps: dict[int, list[tuple[int, int]]] = {}
    places = [a[0] for a in anchors]
    for a, b, rare in pairs:
        gap = bisect_left(places, a) - 1
        if not rare and anchors[gap][1] < b and (gap + 1 == len(anchors) or (a < places[gap + 1] and b < anchors[gap + 1][1])):
            gaps.setdefault(gap, []).append((a, b))
    return sorted(anchors[1:] + [p for inside in gaps.values() for p in _rising(inside)])


def _cut(batch: pa.RecordBatch, least: int) -> pa.Array:
    """Of each document the flags of the lines that leave it, up to the last of them; empty if none does."""
    found = batch["found"]
    doc = np.repeat(np.arange(len(found)), np.diff(found.offsets.to_numpy()))
    shared = found.flatten()
    take = lambda name: shared.field(name).to_numpy(zero_copy_only=False)
    first, pos, there = take("first_id"), take("pos"), take("there")
    order = np.lexsort((-there, pos, first, doc))
    doc, first, pos, there = doc[order], first[order], pos[order], there[order]
    pair = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (first[1:] != first[:-1])]) - 1
    stay = np.r_[True, (pair[1:] != pair[:-1]) | (pos[1:] != pos[:-1]) | (there[1:] != there[:-1])]
    order, doc, pair, pos, there = order[stay], doc[stay], pair[stay], pos[stay], there[stay]
    crossed = (pair[1:] == pair[:-1]) & ((pos[1:] <= pos[:-1]) | (there[1:] <= there[:-1]))
    rare, keep = take("rare")[order], np.ones(len(order), bool)
    edges = np.searchsorted(pair, np.arange(pair[-1] + 2)) if len(pair) else pair
    for p in np.unique(pair[1:][crossed]):  # the others rise as they are
        a, b = edges[p], edges[p + 1]
        own = list(zip(pos[a:b].tolist(), there[a:b].tolist()))
        good = set(patience([(*x, r) for x, r in zip(own, rare[a:b].tolist())]))
        keep[a:b] = [x in good for x in own]
    order, doc, pair, pos, there = order[keep], doc[keep], pair[keep], pos[keep], there[keep]
    lo, hi, from_line, to_line, chars_to, chars_past = (take(n)[order].astype(np.int64) for n in _PLACES[1:])
    new = np.r_[True, (pair[1:] != pair[:-1]) | (there[1:] - pos[1:] != there[:-1] - pos[:-1]) | (lo[1:] > hi[:-1])]
    edge = np.flatnonzero(new[: len(order)])
    flags: list[list[bool]] = [[] for _ in range(len(found))]
    if len(edge):
        last = np.r_[edge[1:], len(order)] - 1
        size = np.maximum.reduceat(chars_past, edge) - np.minimum.reduceat(chars_to, edge)
        a, b = np.minimum.reduceat(from_line, edge), np.maximum.reduceat(to_line, edge)
        big = size >= least
        a, b, of = a[big], b[big], doc[last[big]]
        for i in np.unique(of):
            mine = of == i if len(of) < 64 else slice(np.searchsorted(of, i), np.searchsorted(of, i, "right"))
            change = np.zeros(int(b[mine].max()) + 1, np.int32)
            np.add.at(change, a[mine], 1)
            np.add.at(change, b[mine], -1)
            flags[i] = (np.cumsum(change[:-1]) > 0).tolist()
    return pa.array(flags, pa.list_(pa.bool_()))


def removed_lines(docs: DataFrame, min_block_chars: int = MIN_BLOCK_CHARS, rare_docs: int = RARE_DOCS) -> DataFrame:
    """doc_id, mark (xxhash64 of the text) and ``gone``, a flag for each line up to the last that leaves.

    Documents that lose no line are absent.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, found in line_keys(batch["text"], min_block_chars):
                own = [batch["doc_id"].take(pa.array(row)), batch["mark"].take(pa.array(row))]
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, found.values())], ["doc_id", "mark", *found])

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("mark"), "text")
    lines = settle(texts.mapInArrow(keys, "doc_id long, mark long, key long, " + ", ".join(f"{p} int" for p in _PLACES)))
    held = lines.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.max("doc_id").alias("last_id"), F.count("*").alias("n"))
    held = settle(held.where("first.doc_id < last_id").select("key", F.col("first.doc_id").alias("first_id"), F.col("first.pos").alias("there"), "n"))
    shared = join_hot(lines, held, "key", "n").where("first_id < doc_id")
    found = F.struct("first_id", "there", *_PLACES, (F.col("n") <= rare_docs).alias("rare"))
    later = shared.groupBy("doc_id", "mark").agg(F.collect_list(found).alias("found"))  # a document's own lines

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["mark"], _cut(part, min_block_chars)], ["doc_id", "mark", "gone"])

    return later.mapInArrow(align, "doc_id long, mark long, gone array<boolean>").where(F.size("gone") > 0)


def dedup_lines(docs: DataFrame, min_block_chars: int = MIN_BLOCK_CHARS, rare_docs: int = RARE_DOCS) -> DataFrame:
    """``docs`` with the lines gone from ``text``, and n_lines and n_removed of each document."""
    docs = docs.drop("n_lines", "n_removed")
    own = free_name(docs, "cut")
    removed = removed_lines(docs.select("doc_id", "text"), min_block_chars, rare_docs)
    gone = removed.select(F.struct("doc_id", "mark", "gone").alias(own))
    out = docs.join(gone, (F.col("doc_id").cast("long") == F.col(f"{own}.doc_id")) & (F.xxhash64("text") == F.col(f"{own}.mark")), "left")
    flags, lines = F.col(f"{own}.gone"), F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.coalesce(F.get(flags, i), F.lit(False)))  # one split a text; a flag is found by its place
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("int")
    return out.withColumns(
        {
            "n_lines": n_lines,
            "n_removed": F.coalesce(F.size(F.filter(flags, lambda x: x)), F.lit(0)),
            "text": F.when(flags.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        }
    ).drop(own)
