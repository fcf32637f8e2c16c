"""Merkle manifest of a table: leaves in groups, a tree over each group's leaves and one over the groups' roots.

Leaves are cut into superblocks of 2 ** HEIGHT neighbours. A first pass reduces each to one outer node, and outer nodes
likewise until one is left; their number falls by the same factor each time. Coming down, a superblock's nodes are
cogrouped with the one row that holds the path of its outer node. The last such exchange cogroups the leaves with
their outer paths: there the local tree is built, proofs are joined and both leaves are folded, in one applyInPandas.

An entry of a path is ``L`` or ``R``, the side on which the sibling stands, and its digest; it is empty where a node
at the end of a level has none and is hashed alone.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .placing import placed

HEIGHT = 12  # 4096 leaves a superblock


def field_bytes(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 bytes, counted, a colon and the value."""
    said = value.cast("string")
    return F.when(said.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field_bytes, fields)), 256)


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels_of(digests: list[str], height: int) -> list[list[str]]:
    """The levels of a tree, ``height`` of them above its leaves."""
    levels = [digests]
    for _ in range(height):
        at = levels[-1]
        levels.append([digest(*at[i : i + 2]) for i in range(0, len(at), 2)])
    return levels


def path_of(levels: list[list[str]], place: int) -> list[str]:
    """The entries from a leaf up to the level below the top."""
    path = []
    for at in levels[:-1]:
        other = place ^ 1
        path.append(("L" if place & 1 else "R") + at[other] if other < len(at) else "")
        place >>= 1
    return path


def folded(leaf: str, path: list[str]) -> str:
    for entry in path:
        leaf = digest(leaf) if not entry else digest(entry[1:], leaf) if entry[0] == "L" else digest(leaf, entry[1:])
    return leaf


def proof_digest(path: list[str]) -> str:
    return digest(*(entry[1:] for entry in path))


def _local_height(size: int, height: int) -> int:
    """Levels of a superblock's tree; the tree over ``size`` leaves ends where one node is left."""
    return min(height, (int(size) - 1).bit_length())


def _block(height: int) -> Column:
    return F.shiftright("pos", height).alias("block")


def _reduced(nodes: DataFrame, height: int) -> DataFrame:
    """(g, pos, size, node): one node for each superblock of nodes of the same shape."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = int(rows["size"].iloc[0])
        top = levels_of(rows.sort_values("pos")["node"].tolist(), _local_height(size, height))[-1][0]
        return pd.DataFrame({"g": [key[0]], "pos": [key[1]], "size": [-(-size >> height)], "node": [top]})

    return nodes.select("g", "pos", "size", "node").groupBy("g", _block(height)).applyInPandas(run, "g long, pos long, size long, node string")


def _tiers(leaves: DataFrame, height: int) -> list[DataFrame]:
    """The leaves, and outer nodes up to one for each g."""
    tiers, most = [leaves], leaves.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    while most > 1:
        tiers.append(settle(_reduced(tiers[-1], height)))
        most = -(-most >> height)
    return tiers


_CARRIED = "subroot string, root string"


def _paths(nodes: DataFrame, outer: DataFrame, height: int) -> DataFrame:
    """(g, pos, node, path, subroot, root) of nodes, whose superblocks have the paths in ``outer`` (g, pos, path, subroot, root)."""

    def run(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        levels = levels_of(rows["node"].tolist(), _local_height(rows["size"].iloc[0], height)) if len(rows) else []
        at = above.iloc[0]
        paths = [path_of(levels, i) + list(at["path"]) for i in range(len(rows))]
        return pd.DataFrame({"g": rows["g"], "pos": rows["pos"], "node": rows["node"], "path": paths, "subroot": at["subroot"], "root": at["root"]})

    mine = nodes.select("g", "pos", "size", "node").groupBy("g", _block(height))
    theirs = outer.select("g", "pos", "path", "subroot", "root").groupBy("g", "pos")
    return mine.cogroup(theirs).applyInPandas(run, f"g long, pos long, node string, path array<string>, {_CARRIED}")


def _down(tiers: list[DataFrame], outer: DataFrame, height: int) -> DataFrame:
    """``outer``, the top's path, carried to the nodes of the second tier from below."""
    for nodes in reversed(tiers[1:-1]):
        outer = settle(_paths(nodes, outer, height))
    return outer


def manifest(leaves: DataFrame, group: str, key: str, height: int | None = None) -> DataFrame:
    """(key, group, leaf, subroot, root, proof, folded, verified) of rows (key, group, leaf, changed).

    ``changed`` is the digest of the row as somebody hands it over, null where nothing is handed over but the row itself. It is
    folded with the siblings of ``leaf`` and stands the test when that gives the root.

    Leaves of a group ascend by key, nulls first, rows that repeat a key by their leaf; equal rows have a leaf each. Groups ascend
    bytewise, null first. A lone leaf is its group's root, and a lone group's root is the table's. An empty table gives no row.
    """
    height = height or HEIGHT
    rows = leaves.select(F.col(key).alias("key"), F.col(group).alias("of"), "leaf", "changed")
    rows = placed(rows, "of", ["key", "leaf"]).select("key", "of", "changed", F.col("_group").alias("g"), F.col("_pos").alias("pos"), F.col("_size").alias("size"), F.col("leaf").alias("node"))
    rows = settle(rows)
    tiers = _tiers(rows, height)
    named = rows.groupBy("g").agg(F.first("of").alias("of"))
    subroots = tiers[-1].select("g", "node").join(named, "g").select(F.lit(0).alias("all"), F.col("g").alias("mine"), "of", "node")
    subroots = settle(placed(subroots, "all", ["of"]).select("mine", F.lit(0).cast("long").alias("g"), F.col("_pos").alias("pos"), F.col("_size").alias("size"), "node"))
    over = _tiers(subroots, height)
    nothing = F.array().cast("array<string>").alias("path")
    top = over[-1].select("g", "pos", nothing, F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    if len(over) > 1:
        top = _paths(subroots, _down(over, top, height), height)
    at = subroots.select("mine", "pos", F.col("node").alias("subroot")).join(top.select("pos", "path", "root"), "pos")
    outer = settle(at.select(F.col("mine").alias("g"), F.lit(0).cast("long").alias("pos"), "path", "subroot", "root"))
    outer = _down(tiers, outer, height)

    def finish(block: tuple, mine: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("pos")
        levels = levels_of(mine["node"].tolist(), _local_height(mine["size"].iloc[0], height)) if len(mine) else []
        at, out = above.iloc[0], []
        for i, (leaf, changed) in enumerate(zip(mine["node"], mine["changed"])):
            path = path_of(levels, i) + list(at["path"])
            out.append((proof_digest(path), folded(changed if isinstance(changed, str) else leaf, path)))
        proofs, ends = zip(*out) if out else ((), ())
        return pd.DataFrame({"g": mine["g"], "pos": mine["pos"], "leaf": mine["node"], "subroot": at["subroot"], "root": at["root"], "proof": proofs, "folded": ends})

    whole = f"g long, pos long, leaf string, {_CARRIED}, proof string, folded string"
    done = rows.select("g", "pos", "size", "node", "changed").groupBy("g", _block(height)).cogroup(outer.groupBy("g", "pos")).applyInPandas(finish, whole)
    found = done.join(rows.select("g", "pos", "key", "of"), ["g", "pos"])
    return found.select(F.col("key").alias(key), F.col("of").alias(group), "leaf", "subroot", "root", "proof", "folded", (F.col("folded") == F.col("root")).alias("verified"))
