"""N-gram Jaccard join: count-vector R-trees.

A document's set is its distinct word shingles (ASCII lower case). Shingles are hashed into groups and the
counts per group are a point; the sum of coordinate minima of two points bounds the overlap of their sets.

1. Documents of one set become one representative with the smallest doc_id. Sets count as one when their sizes
   and two 64-bit sums over their shingles are equal.
2. Representatives meet in cells. Two sets of the wanted similarity share one of the first
   ``n - ceil(threshold * n) + 1`` shingles of each in any fixed order, so a cell is a shingle of that prefix.
   The order puts shingles that are frequent in the corpus last, which keeps cells small; whatever
   counts the order uses, no pair is lost.
3. Stars: in each cell every document is paired with the smallest one; pairs that pass the bound are
   verified on the whole sets. Nearly all copies of a family are connected by that.
4. The rest of a cell are documents still in different components. An R-tree over their points (packed by
   component and size, boxes with the largest counts) is joined with itself: pairs of boxes, then pairs of
   points, whose summed minima are too small are left out. Survivors are verified. Cells of
   many documents are dealt out as pairs of blocks.
5. Components of all verified links.

Where a plain R-tree over the corpus would prune nothing: in hundreds of dimensions its boxes all overlap and
every document would visit every box of its size, which is quadratic; hence the cells.

Defined cases: a null or empty text, or one without words, has the empty set and links with nothing; fewer
words than a shingle make one shingle of the whole; a null doc_id is left out; repeated rows are copies; rows
that repeat a doc_id with other texts are one document with several sets, linked by any of them, and each row has its own
n_shingles; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, settle, utf8_slices
from .graph_parts import components
from .words import LOWER, grams, mix, words

FEW, MANY, LONG = 256, 2048, 2000  # groups of all sets and of long ones, and the size from which a set is long
HEAVY_KEYS, HEAVY_LOCAL, HEAVY_RUN = 1 << 18, 3, 1 << 22
BLOCK, SALT = 2048, 256
LEAF = 16
FULL = {FEW: 255, MANY: 65535}  # the largest count that a point holds


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and sorted distinct shingle hashes of each row, for runs of rows."""
    for first, last, raw, off in utf8_slices(column):
        _, _, row, code = words(LOWER[raw], off)
        at = np.searchsorted(row, np.arange(last - first + 1))
        gram, whole = grams(code, row, k)
        out = []
        for a, b in zip(at, at[1:]):
            if b - a >= k:
                out.append(np.unique(gram[a : b - k + 1]))
            elif b > a:
                out.append(grams(code[a:b], row[a:b], b - a)[0])
            else:
                out.append(np.zeros(0, np.uint64))
        yield first, out


def _heavy(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that some run of HEAVY_RUN shingles has HEAVY_LOCAL times, the most frequent HEAVY_KEYS, sorted."""

    def often(held: list[np.ndarray]) -> pa.RecordBatch:
        gram = np.sort(np.concatenate(held))
        edge = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
        n = np.diff(np.r_[edge, len(gram)])
        many = n >= HEAVY_LOCAL
        return pa.RecordBatch.from_arrays([pa.array(gram[edge[many]].view(np.int64)), pa.array(n[many])], ["key", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, raw, off in utf8_slices(batch["text"]):
                _, _, row, code = words(LOWER[raw], off)
                gram, whole = grams(code, row, k)
                held.append(gram[whole])
                size += len(held[-1])
                if size >= HEAVY_RUN:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)

    seen = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    top = seen.orderBy(F.desc("n"), "key").limit(HEAVY_KEYS).select("key").toArrow()["key"].to_numpy()
    return np.sort(top.astype(np.int64).view(np.uint64))


def _points(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, two sums that identify the set, prefix and counts per group."""
    shared = docs.sparkSession.sparkContext.broadcast(_heavy(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy = shared.value
        for batch in batches:
            ids, at = batch["doc_id"], 0
            for first, sets in _sets(batch["text"], k):
                n = np.array([len(s) for s in sets])
                sums, prefixes, counts, few = [], [], [], []
                for s in sets:
                    x = mix(s ^ np.uint64(0x5851F42D4C957F2D))
                    sums.append((int(s.sum(dtype=np.uint64)), int(x.sum(dtype=np.uint64))))
                    p = len(s) + (-percent * len(s)) // 100 + 1 if len(s) else 0
                    if len(heavy) and len(s):
                        often = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
                        s_by = np.concatenate([s[~often], s[often]]) if often.any() else s
                    else:
                        s_by = s
                    prefixes.append(s_by[:p].view(np.int64))
                    groups = MANY if len(s) >= LONG else FEW
                    count = np.bincount((x >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups)
                    counts.append(_point(count, groups))
                    few.append(_point(count, FEW))
                sums = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
                cuts = np.r_[0, np.cumsum([len(p) for p in prefixes])].astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)))
                cols = [ids.slice(at, len(n)), pa.array(n, pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1]), prefix, pa.array(counts, pa.binary()), pa.array(few, pa.binary())]
                at += len(n)
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "s1", "s2", "prefix", "counts", "few"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, n int, s1 long, s2 long, prefix array<long>, counts binary, few binary")


def _point(count: np.ndarray, groups: int) -> bytes:
    """Counts as bytes, of ``groups`` coordinates; finer groups are summed. Few groups take a byte each, many take two."""
    coarse = count.reshape(groups, -1).sum(axis=1)
    return np.minimum(coarse, FULL[groups]).astype(np.uint8 if groups == FEW else np.uint16).tobytes()


def _stacked(points: list[bytes]) -> np.ndarray:
    """Points of few coordinates as rows."""
    same = [p if len(p) == FEW else _point(np.frombuffer(p, np.uint16).astype(np.int64), FEW) for p in points]
    return np.frombuffer(b"".join(same), np.uint8).reshape(-1, FEW)


def _full(points: np.ndarray) -> np.ndarray:
    """Rows with a coordinate that may stand for more; two such sets are always compared whole."""
    return (points == (255 if points.dtype == np.uint8 else 65535)).any(axis=1)


def _enough(overlap: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap, or a bound of it, allows the similarity: 100 * i >= percent * (n + m - i)."""
    return (100 + percent) * overlap.astype(np.int64) >= percent * (n.astype(np.int64) + m)


def tree_join(points: np.ndarray, n: np.ndarray, part: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of rows of different parts whose bound allows the similarity, by an R-tree joined with itself."""
    order = np.lexsort((n, part))
    full = _full(points)[order]
    points, n, part = points[order].astype(np.int32), n[order], part[order]
    starts = np.arange(0, len(n), LEAF)
    top, filled = np.maximum.reduceat(points, starts), np.maximum.reduceat(full, starts)
    low, high = np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
    one = np.minimum.reduceat(part, starts) == np.maximum.reduceat(part, starts)
    found = []
    for i, a in enumerate(starts):
        bound = np.minimum(top[i], top[i:]).sum(axis=1)
        fits = (_enough(bound, low[i], low[i:], percent) | (filled[i] & filled[i:])) & (100 * high[i:] >= percent * low[i]) & (100 * high[i] >= percent * low[i:])
        fits &= ~(one[i] & one[i:] & (part[a] == part[starts[i:]]))
        for j in np.flatnonzero(fits) + i:
            b = starts[j]
            x, y = slice(a, a + LEAF), slice(b, b + LEAF)
            overlap = np.minimum(points[x, None], points[None, y]).sum(axis=2)
            good = (_enough(overlap, n[x, None], n[None, y], percent) | (full[x, None] & full[None, y])) & (part[x, None] != part[None, y])
            p, q = np.nonzero(np.triu(good, 1) if i == j else good)
            found.append(np.stack([p + a, q + b], axis=1))
    return order[np.concatenate(found)] if found else np.zeros((0, 2), np.int64)


def _leaf_pairs(points: np.ndarray, n: np.ndarray, part: np.ndarray, cell: np.ndarray, percent: int) -> np.ndarray:
    """The same for many cells of one leaf each, at once: rows of a cell lie together and are at most LEAF."""
    found, full = [], _full(points)
    for apart in range(1, min(LEAF, len(n))):
        i = np.flatnonzero((cell[apart:] == cell[:-apart]) & (part[apart:] != part[:-apart]))
        j = i + apart
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        near = 100 * low >= percent * high
        i, j = i[near], j[near]
        for at in range(0, len(i), 1 << 16):
            x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            good = _enough(np.minimum(points[x], points[y]).sum(axis=1, dtype=np.int64), n[x], n[y], percent) | (full[x] & full[y])
            found.append(np.stack([x[good], y[good]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _bounded(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose points allow the similarity."""
    point = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("counts").alias(f"c_{x}"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fine = ((f["c_a"].str.len() > FEW) & (f["c_b"].str.len() > FEW)).to_numpy(bool)
            good = np.zeros(len(f), bool)
            for which in (fine, ~fine):
                g = f[which]
                if which is fine:
                    a, b = (np.frombuffer(b"".join(g[c].tolist()), np.uint16).reshape(-1, MANY) for c in ("c_a", "c_b"))
                else:
                    a, b = _stacked(g["c_a"].tolist()), _stacked(g["c_b"].tolist())
                overlap = np.minimum(a, b).sum(axis=1, dtype=np.int64)
                good[which] = _enough(overlap, g["n_a"].to_numpy(), g["n_b"].to_numpy(), percent) | (_full(a) & _full(b))
            yield f.loc[good, ["a", "b"]]

    return pairs.join(point("b"), "b").join(point("a"), "a").mapInPandas(run, "a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity. ``pairs`` is settled; a is shared by many."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(SALT)).cast("int").alias("salts"))
    firsts = salts.select("a", F.col("a").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("hub"))
    rest = pairs.join(salts, "a").select("a", F.col("b").alias("id"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(False).alias("hub"))
    wanted = settle(firsts.unionByName(rest))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for _, found in _sets(batch["text"], k):
                keys = [batch[c].slice(at, len(found)) for c in ("a", "id", "salt", "hub")]
                at += len(found)
                yield pa.RecordBatch.from_arrays([*keys, pa.array([s.tobytes() for s in found], pa.binary())], ["a", "id", "salt", "hub", "elements"])

    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("id")).select("a", "id", "salt", "hub", "text")
    members = texts.mapInArrow(sets, "a long, id long, salt int, hub boolean, elements binary")

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        first = f.loc[f["hub"], "elements"]
        others = f.loc[~f["hub"]].drop_duplicates("id")
        if not len(first) or not len(others):
            return pd.DataFrame({"a": [], "b": []}).astype("int64")
        x = np.frombuffer(first.iloc[0], np.uint64)
        bags = [np.frombuffer(e, np.uint64) for e in others["elements"]]
        sizes = np.array([len(s) for s in bags])
        every = np.concatenate(bags)
        hit = np.r_[0, np.cumsum(x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every)]
        ends = np.cumsum(sizes)
        overlap = hit[ends] - hit[ends - sizes]
        good = _enough(overlap, np.full(len(bags), len(x)), sizes, percent)
        return pd.DataFrame({"a": f["a"].iloc[0], "b": others["id"].to_numpy()[good]})

    return members.groupBy("a", "salt").applyInPandas(compare, "a long, b long")


def _rest_pairs(cells: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a cell and pass the tree. Cells: key, doc_id, n, part, few, size."""
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    dealt = cells.withColumns({"blocks": blocks, "mine": F.pmod(F.xxhash64("doc_id"), blocks).cast("int")})
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "doc_id", "n", "part", "few")

    def search(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["key", "x", "y", "part", "n"], kind="stable")
        points = _stacked(f["few"].tolist())
        ids, n, part = f["doc_id"].to_numpy(), f["n"].to_numpy(np.int64), f["part"].to_numpy()
        k = f[["key", "x", "y"]].to_numpy()
        cuts = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1, len(f)]
        size = np.diff(cuts)
        cell = np.repeat(np.arange(len(size)), size)
        small = np.flatnonzero(np.repeat(size <= LEAF, size))
        found = [small[_leaf_pairs(points[small], n[small], part[small], cell[small], percent)]]
        for i in np.flatnonzero(size > LEAF):
            at = slice(cuts[i], cuts[i + 1])
            found.append(cuts[i] + tree_join(points[at], n[at], part[at], percent))
        pairs = ids[np.concatenate(found)]
        return pd.DataFrame({"a": pairs.min(axis=1, initial=2**62), "b": pairs.max(axis=1, initial=-1)}).drop_duplicates()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # rows of the last cell, which may go on
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            if len(f):
                end = f.iloc[-1]
                rest = ((f["key"] == end["key"]) & (f["x"] == end["x"]) & (f["y"] == end["y"])).to_numpy()
                held = f[rest]
                if not rest.all():
                    yield search(f[~rest])
        if held is not None and len(held):
            yield search(held)

    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInPandas(run, "a long, b long").distinct()


def link_similar(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id of each document; linked when 100 * overlap >= percent * union."""
    docs = docs.select("doc_id", "text")
    mark = F.xxhash64("text")
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(mark).alias("p"), F.max(mark).alias("q"))
    several = settle(several.where("p <> q").select("doc_id"))
    return _linked(docs, k, percent) if several.isEmpty() else _linked_by_text(docs, several, k, percent)


def _linked_by_text(docs: DataFrame, several: DataFrame, k: int, percent: int) -> DataFrame:
    """The same where the ids in ``several`` have several texts: each text gets a number of its own below all ids."""
    marked = docs.withColumn("mark", F.xxhash64("text")).join(several, "doc_id", "left_semi")
    low = docs.agg(F.least(F.min("doc_id"), F.lit(0))).first()[0]
    named = settle(marked.dropDuplicates(["doc_id", "mark"]).withColumn("own", F.lit(low - 1) - F.monotonically_increasing_id()))
    found = _linked(docs.join(several, "doc_id", "left_anti").unionByName(named.select(F.col("own").alias("doc_id"), "text")), k, percent)
    found = settle(found.join(named.select(F.col("own").alias("doc_id"), F.col("doc_id").alias("real"), "mark"), "doc_id", "left"))
    parts = found.where("real is not null").select("real", F.col("component_id").alias("a")).distinct()
    edges = parts.join(parts.groupBy("real").agg(F.min("a").alias("b")), "real").where("a <> b").select("a", "b")
    merged = components(edges).select(F.col("id").alias("component_id"), "component")
    whole = settle(found.join(merged, "component_id", "left").withColumn("part", F.coalesce("component", "component_id")).drop("component", "component_id"))
    least = whole.groupBy("part").agg(F.min(F.coalesce("real", "doc_id")).alias("component_id"), F.count("*").alias("size"))
    whole = join_hot(whole, settle(least), "part", "size")
    plain = whole.where("real is null").select("doc_id", "n_shingles", "component_id")
    rows = marked.select("doc_id", "mark").join(whole.where("real is not null").select(F.col("real").alias("doc_id"), "mark", "n_shingles", "component_id"), ["doc_id", "mark"])
    return plain.unionByName(rows.drop("mark"))


def _linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    base = settle(_points(docs, k, percent))
    same = ["n", "s1", "s2"]
    heads = settle(base.where("n > 0").groupBy(same).agg(F.min("doc_id").alias("rep")))
    reps = base.join(heads.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    reps = settle(reps.select("doc_id", "n", "prefix", "counts", "few"))
    rows = reps.select("doc_id", "n", F.explode("prefix").alias("key"))
    shared = settle(rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "n")).alias("hub")).where("size > 1"))
    cells = settle(join_hot(rows, shared, "key", "size").select("key", "doc_id", "n", "size", F.col("hub.doc_id").alias("a"), F.col("hub.n").alias("m")))
    near = f"100 * least(n, m) >= {percent} * greatest(n, m)"
    stars = settle(cells.where("doc_id <> a").where(near).select("a", F.col("doc_id").alias("b")).distinct())
    links = settle(_verified(docs, settle(_bounded(stars, reps, percent)), k, percent))
    parts = components(links)
    labelled = cells.select("key", "doc_id", "n", "size").join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    labelled = settle(labelled.withColumn("part", F.coalesce("component", "doc_id")).drop("component"))
    open_keys = labelled.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    left = labelled.join(open_keys, "key").join(reps.select("doc_id", "few"), "doc_id")
    more = settle(_rest_pairs(left, percent).join(stars, ["a", "b"], "left_anti"))
    links = links.unionByName(settle(_verified(docs, settle(_bounded(more, reps, percent)), k, percent)))
    parts = components(links)
    whole = heads.join(parts, heads["rep"] == parts["id"], "left").select(*same, F.coalesce("component", "rep").alias("whole"))
    out = base.select("doc_id", *same).join(whole, same, "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("whole", "doc_id").alias("component_id"))
