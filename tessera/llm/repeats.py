"""Substring dedup: windows of words that also start in an earlier document.

1. Every window of ``window`` words has a minimizer, the least hash of its 5-word runs. Consecutive windows
   with one minimizer are a segment; equal windows have equal minimizers. Minimizers that occur in two
   documents are marked in a bit vector of a fixed size, which goes to all tasks. A wrong mark costs
   work and changes no result; the number of shards counts the segments that it routes.
2. Marked segments go to shards by minimizer. Each shard lays its distinct segments end to end in a
   compressed FM-index (a wavelet matrix over the Burrows-Wheeler transform); the segments are then streamed
   through it by backward search, which gives the smallest doc_id in which each window starts. Minimizers
   of so many segments that they would fill a shard are dealt out window by window, and a window that is
   everywhere is sent by each task for its smallest document and one more, not for all.
3. The windows found meet their documents, whose covered words go.

Words count as equal when their 32-bit fingerprints do; a window is 13 of them in order. Segments count as
equal when their 64-bit content hashes do.

Defined cases: a null or empty text has no words and an empty result; a null doc_id takes no part and keeps
its words; rows that repeat a doc_id with other texts are judged each by its own text, and windows are never
compared within one doc_id; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import settle, utf8_slices
from .fm_index import Windows
from .words import grams, mix, words

GRAM, RUN = 5, 24
MARK_BITS, HOT_BITS, SENT = 1 << 26, 1 << 23, 1 << 20
SHARD_SEGMENTS = 120_000


def _segments(raw: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Word hashes, each word's row, and of each segment the first word, windows and minimizer."""
    _, _, row, code = words(raw, off)
    n = len(code) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return code, row, none, none, np.zeros(0, np.uint64)
    gram, _ = grams(code, row, GRAM)
    least = gram[:n].copy()
    for step in range(1, window - GRAM + 1):
        np.minimum(least, gram[step : step + n], out=least)
    whole = row[:n] == row[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1]) | ~whole[:-1]
    starts = np.flatnonzero(new & whole)
    ends = np.flatnonzero(whole & np.r_[new[1:] | ~whole[1:], True]) + 1
    parts = -(-(ends - starts) // RUN)  # long runs are cut
    within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(starts, parts) + within * RUN
    count = np.minimum(np.repeat(ends, parts) - first, RUN)
    return code, row, first, count, np.repeat(least[starts], parts)


def _stream(docs: DataFrame, window: int, start, schema: str) -> DataFrame:
    """Run over the segments of runs of rows what ``start()`` gives a task; it yields columns of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = start()
        for batch in batches:
            ids, marks = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "mark"))
            for first, _, raw, off in utf8_slices(batch["text"]):
                code, row, at, count, key = _segments(raw, off, window)
                local = np.searchsorted(row, row[at]) if len(at) else at
                of = first + row[at] if len(at) else at
                for columns in emit(code, ids[of], marks[of], at, at - local, count, key):
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))

    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(run, schema)


class Marks:
    """The repeated minimizers as bits, and as bits those too frequent for one shard."""

    def __init__(self, bits: np.ndarray, hot: np.ndarray):
        self.bits, self.hot = bits, hot

    def chosen(self, key: np.ndarray) -> np.ndarray:
        return _bit(self.bits, key)


def _bit(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = (key & np.uint64(len(bits) * 64 - 1)).astype(np.int64)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def _bits(keys: DataFrame, size: int) -> np.ndarray:
    """A bit vector of ``size`` bits (a power of two) with those of ``key`` set: size / 64 rows at most are collected."""
    at = F.col("key").bitwiseAND(size - 1)
    filled = keys.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bits"))
    filled = filled.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[filled["word"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    return bits


class _Sent:
    """Contents of hot minimizers that a task has sent with two documents, so that it need not send them again.

    A content is sent anew for a smaller document, or for a second one. When it is full it starts over, which costs rows alone.
    """

    def __init__(self):
        self.known: dict[int, tuple[int, bool]] = {}

    def wanted(self, content: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        if len(self.known) >= SENT:
            self.known.clear()
        out = np.ones(len(content), bool)
        for i, (c, p, q) in enumerate(zip(content.tolist(), least.tolist(), most.tolist())):
            before = self.known.get(c)
            if before is not None and before[0] <= p and (before[1] or q <= before[0]):
                out[i] = False
            else:
                self.known[c] = (p, q > p) if before is None else (min(p, before[0]), before[1] or max(q, before[0]) > min(p, before[0]))
        return out


def _mark(docs: DataFrame, window: int) -> tuple[Marks, int]:
    """Marks and the number of shards."""

    def emit(code, doc, mark, at, place, count, key):
        yield {"key": key.view(np.int64), "doc_id": doc}

    seen = _stream(docs, window, lambda: emit, "key long, doc_id long").groupBy("key").agg(F.min("doc_id").alias("p"), F.max("doc_id").alias("q"), F.count("*").alias("n"))
    all_segments = Observation()
    seen = seen.observe(all_segments, F.sum("n").alias("n"))
    again = settle(seen.where("p < q").select("key", "n"))
    total = again.agg(F.sum("n")).first()[0] or 0
    bits = _bits(again, MARK_BITS)
    full = float(np.bitwise_count(bits).sum()) / MARK_BITS
    routed = total + ((all_segments.get["n"] or 0) - total) * full  # with those that are marked by chance
    shards = max(1, math.ceil(routed / SHARD_SEGMENTS))
    hot = _bits(again.where(F.col("n") > max(1000, total // (4 * shards))), HOT_BITS)  # a wrong hot mark costs work and changes no result
    return Marks(bits, hot), shards


def _marked(marks: Marks, code, doc, at, place, count, key, window: int):
    """The marked segments; those of hot minimizers as single windows with keys of their own; and a content key."""
    use = marks.chosen(key)
    doc, at, place, count, key = doc[use], at[use], place[use], count[use], key[use]
    hot = _bit(marks.hot, key)
    single = hot
    if hot.any():
        n = np.where(hot, count, 1)
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        single = np.repeat(hot, n)
        doc, at, place = np.repeat(doc, n), np.repeat(at, n) + step, np.repeat(place, n) + step
        count = np.where(single, 1, np.repeat(count, n))
        key = np.repeat(key, n)
    content = key.copy()
    with np.errstate(over="ignore"):
        for step in range(RUN + window - 1):
            inside = count + window - 1 > step
            content[inside] = mix(content[inside] * np.uint64(0x9E3779B97F4A7C15) + code[at[inside] + step])
    return doc, at, place, count, np.where(single, content, key), content, single


def repeated_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, mark (xxhash64 of the text) and ``starts``, the places (from 0) of the words where repeated windows start."""
    if not 1 < window <= 16:
        raise ValueError("windows have 2 to 16 words")
    if window < GRAM:
        raise ValueError(f"windows have at least {GRAM} words")
    docs = docs.select("doc_id", "text")
    marks, shards = _mark(docs, window)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def contents():
        sent = _Sent()

        def emit(code, doc, mark, at, place, count, key):
            doc, at, place, count, key, content, single = _marked(shared.value, code, doc, at, place, count, key, window)
            if not len(doc):
                return
            order = np.lexsort((doc, content))
            edge = np.flatnonzero(np.r_[True, content[order][1:] != content[order][:-1]])
            least, most = doc[order][edge], np.maximum.reduceat(doc[order], edge)
            pick = order[edge]
            often = np.flatnonzero(single[pick])
            if len(often):
                wanted = np.ones(len(pick), bool)
                wanted[often] = sent.wanted(content[pick[often]], least[often], most[often])
                pick, least, most = pick[wanted], least[wanted], most[wanted]
                if not len(pick):
                    return
            size = count[pick] + window - 1
            spread = np.repeat(at[pick] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            bodies = (code[spread] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            ends = (np.r_[0, np.cumsum(size)] * 4).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(pick), [None, pa.py_buffer(ends), pa.py_buffer(bodies)])
            shard = (mix(key[pick]) % np.uint64(shards)).astype(np.int32)
            yield {"shard": shard, "content": content[pick].view(np.int64), "p": least, "q": most, "body": binary}

        return emit

    def places(code, doc, mark, at, place, count, key):
        of, at, place, count, key, content, _ = _marked(shared.value, code, np.arange(len(doc)), at, place, count, key, window)
        yield {"content": content.view(np.int64), "doc_id": doc[of], "mark": mark[of], "place": place.astype(np.int32)}

    def search(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["content", "p"])
        heads = ~f["content"].duplicated()
        most = np.maximum.reduceat(f["q"].to_numpy(), np.flatnonzero(heads))
        f = f[heads]
        size = (f["body"].str.len() // 4).to_numpy(np.int64)
        count = size - window + 1
        symbols = np.frombuffer(b"\0\0\0\0".join(f["body"].tolist()) + b"\0\0\0\0", np.uint32)
        ends = np.cumsum(size + 1) - 1
        separator = np.zeros(len(symbols), bool)
        separator[ends] = True
        label = np.repeat(f["p"].to_numpy(), size + 1)
        least = Windows(symbols, separator, label, window).scan(symbols, ends - size, count, 2**62)
        cuts = np.cumsum(count) - count
        useful = np.minimum.reduceat(least, cuts) < most
        lists = np.split(least, cuts[1:])
        return pd.DataFrame({"content": f["content"].to_numpy()[useful], "least": pd.Series([x for x, u in zip(lists, useful) if u], dtype=object)})

    index = _stream(docs, window, contents, "shard int, content long, p long, q long, body binary")
    found = index.groupBy("shard").applyInPandas(search, "content long, least array<long>")
    asked = _stream(docs, window, lambda: places, "content long, doc_id long, mark long, place int")
    hits = asked.join(settle(found), "content")
    earlier = F.filter(F.transform("least", lambda m, i: F.when(m < F.col("doc_id"), F.col("place") + i)), lambda x: x.isNotNull())
    hits = hits.select("doc_id", "mark", earlier.alias("starts")).where(F.size("starts") > 0)
    return hits.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the words that stay joined by one space."""
    docs = docs.select("doc_id", "text")
    starts = repeated_windows(docs, window).withColumnRenamed("doc_id", "_id")
    joined = docs.join(starts, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("mark")), "left").select("doc_id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, at in zip(batch["text"], batch["starts"]):
                found = (text.as_py() or "").encode().split()  # bytes: splits at 0x20 and 0x09-0x0D
                total.append(len(found))
                if at.is_valid:
                    change = np.zeros(len(found) + 1, np.int32)
                    places = np.unique(at.values.to_numpy())
                    change[places] += 1
                    np.subtract.at(change, np.minimum(places + window, len(found)), 1)
                    stay = np.cumsum(change[:-1]) == 0
                    found = list(compress(found, stay.tolist()))
                gone.append(total[-1] - len(found))
                kept.append(b" ".join(found))
            arrays = [batch["doc_id"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
