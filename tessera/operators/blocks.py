"""Postings in blocks, and exact shortlists that read few of them.

A block holds a token's postings of SLOT neighbouring ids, with how many there are, the largest frequency and the
shortest passage. From these a bound on what the token (or the block) can give a request follows for any state of the
statistics, as a score rises with the frequency and falls with the length.

A shortlist takes four steps, each a few Spark jobs over the requests of a batch:

1. The rarest tokens of a request that together have a few times ``limit`` postings name passages; the best of them are
   scored whole, and the last place of the list has at least the least of these scores.
2. Tokens whose bounds together stay below that score can't bring a passage into the list alone. Of all such sets the one is taken
   that leaves out many postings for little bound, so frequent tokens go first. Only the other tokens' postings are
   exploded, and of these only blocks that can still reach the score.
3. Candidates whose sum and the bounds of the left-out tokens reach the last place are kept.
4. For them alone the left-out tokens are looked up, by (token, slot) and then by (token, id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.bm25 import bm25_idf, bm25_score
from ..functions.text import query_tokens
from ..sources.shared import materialize
from .cells import best_in_cells
from .counted import count_in_blocks

SLOT, SEEDS, LITERAL = 1024, 4, 512
#: A token with more blocks than this, and than 1 / HEAVY_PART of all, is dealt out; there are fewer than HEAVY_PART of them.
HEAVY_BLOCKS, HEAVY_PART = 64, 4096
#: Requests of more tokens than this together are scored in cells.
MANY = 4096
#: Scores are rounded to 9 digits; bounds are compared with more room than that.
ROOM = 1e-8


@dataclass
class BlockIndex:
    """Blocks with ``at``, the number of the commit that wrote them, and what has been taken out since.

    ``dead`` (id, at) are passages removed by a later commit, ``fewer`` (token, df) what they took from the document
    frequencies. ``docs`` (id, doc_len) are those alive, needed for statistics of the moment alone.
    """

    blocks: DataFrame
    n_docs: int
    sum_len: int
    dead: DataFrame | None = None
    fewer: DataFrame | None = None
    docs: DataFrame | None = None


def slot_of(id_: Column) -> Column:
    return F.floor(id_ / SLOT)


def blocks_of(memory: DataFrame, text: str = "text") -> DataFrame:
    """Blocks of passages (id, collection, text) and, with a null token, the passages' lengths; ids occur once."""
    return count_in_blocks(memory, text, SLOT)


def in_blocks(postings: DataFrame) -> DataFrame:
    """Blocks of postings (collection, token, id, tf, len)."""
    rows = F.array_sort(F.collect_list(F.struct("id", "tf", "len")))
    blocks = postings.groupBy("collection", "token", slot_of(F.col("id")).alias("slot")).agg(F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("len").alias("min_len"), rows.alias("r"))
    part = lambda name: F.transform("r", lambda x: x[name])
    return blocks.select("collection", "token", "slot", "n", "max_tf", "min_len", part("id").alias("ids"), part("tf").alias("tfs"), part("len").alias("lens"))


def lengths_of(made: DataFrame) -> DataFrame:
    """(id, doc_len) of the passages that blocks were made of."""
    return made.where("token is null").select(F.explode(F.arrays_zip("ids", "lens")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.lens").alias("doc_len"))


def build_blocks(memory: DataFrame, text: str = "text") -> BlockIndex:
    """An index for this session; texts are tokenised once."""
    made = materialize(blocks_of(memory, text))
    docs = lengths_of(made)
    n, total = docs.agg(F.count("*"), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
    return BlockIndex(made.where("token is not null").withColumn("at", F.lit(0).cast("long")), n, total, docs=docs)


def _only(blocks: DataFrame, tokens: DataFrame) -> DataFrame:
    """Blocks of the tokens; a few are put into the filter, so that the reader skips what lies between them."""
    few = tokens.select("token").distinct().limit(LITERAL + 1).collect()
    if len(few) <= LITERAL:
        return blocks.where(F.col("token").isin([r[0] for r in few]))
    return blocks.join(tokens.select("token").distinct(), "token", "left_semi")


def running(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``before``: the sum of ``value`` over earlier rows of the key, in two levels of SLOT rows, so that no key is one group."""
    wide = rows.withColumn("_wide", F.floor(F.col(order) / SLOT))
    above = W.partitionBy(*keys).orderBy("_wide").rowsBetween(W.unboundedPreceding, -1)
    sums = wide.groupBy(*keys, "_wide").agg(F.sum(value).alias("_sum")).withColumn("_past", F.coalesce(F.sum("_sum").over(above), F.lit(0)))
    near = W.partitionBy(*keys, "_wide").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    rows = wide.withColumn("_near", F.coalesce(F.sum(value).over(near), F.lit(0))).join(sums.drop("_sum"), [*keys, "_wide"])
    return rows.withColumn("before", F.col("_past") + F.col("_near")).drop("_wide", "_near", "_past")


def _of_the_moment(tokens: DataFrame, blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """Requests' tokens with df, n_docs and avg_len over the passages up to the one that asks (its id is the request_id)."""
    merged = blocks.groupBy("token", "slot").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("ids")).alias("ids"))
    earlier = running(merged.select("token", "slot", "n"), ["token"], "slot", "n").select("token", "slot", "before")
    mine = tokens.withColumn("slot", slot_of(F.col("request_id"))).join(merged, ["token", "slot"]).join(earlier, ["token", "slot"])
    mine = mine.select("request_id", "token", "mult", (F.col("before") + F.size(F.filter("ids", lambda x: x <= F.col("request_id")))).alias("df"))
    slots = docs.withColumn("slot", slot_of(F.col("id")))
    sums = slots.groupBy("slot").agg(F.count("*").alias("n"), F.sum("doc_len").alias("len")).withColumn("all", F.lit(0))
    past = running(sums, ["all"], "slot", "n").select("slot", F.col("before").alias("n_past")).join(running(sums, ["all"], "slot", "len").select("slot", F.col("before").alias("len_past")), "slot")
    upto = W.partitionBy("slot").orderBy("id").rowsBetween(W.unboundedPreceding, W.currentRow)
    state = slots.withColumns({"k": F.count("*").over(upto), "l": F.sum("doc_len").over(upto)}).join(past, "slot")
    n_docs = F.col("n_past") + F.col("k")
    state = state.select(F.col("id").alias("request_id"), n_docs.alias("n_docs"), ((F.col("len_past") + F.col("l")) / n_docs).alias("avg_len"))
    return mine.join(state, "request_id")


def _asked(requests: DataFrame, index: BlockIndex, collection: str | None, as_of: bool, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(request_id, token, mult, idf, avg_len, here, bound, parts) of tokens that the collection has, and its blocks of them.

    ``here`` counts the token's postings in the collection, ``bound`` is the most it can give, ``parts`` how often it is dealt out.
    """
    tokens = requests.select("request_id", F.explode(query_tokens(F.col("request"), settings)).alias("token"))
    tokens = materialize(tokens.groupBy("request_id", "token").agg(F.count("*").alias("mult")))
    blocks = _only(index.blocks, tokens)
    inside = F.lit(True) if collection is None else F.col("collection") == collection
    here = lambda c: F.when(inside, F.col(c))
    heads = blocks.groupBy("token").agg(
        F.sum("n").alias("df"), F.sum(here("n")).alias("here"), F.max(here("max_tf")).alias("max_tf"), F.min(here("min_len")).alias("min_len"), F.count(here("n")).alias("n_blocks")
    )
    if as_of:
        known = _of_the_moment(tokens, blocks, index.docs).join(heads.drop("df"), "token")
    else:
        if index.fewer is not None:
            less = _only(index.fewer, tokens).groupBy("token").agg(F.sum("df").alias("less"))
            heads = heads.join(less, "token", "left").withColumn("df", F.col("df") - F.coalesce("less", F.lit(0))).drop("less")
        state = {"n_docs": F.lit(index.n_docs), "avg_len": F.lit(index.sum_len / max(index.n_docs, 1))}
        known = tokens.join(heads, "token").withColumns(state)
    idf = bm25_idf(F.col("n_docs"), F.col("df"))
    known = known.where("here > 0 and df > 0").withColumn("idf", idf)
    bound = bm25_score(F.col("max_tf"), F.col("min_len"), F.col("avg_len"), F.col("idf"), settings) * F.col("mult")
    known = materialize(known.select("request_id", "token", "mult", "idf", "avg_len", "here", "n_blocks", bound.alias("bound")))
    every = known.select("token", "n_blocks").distinct().agg(F.coalesce(F.sum("n_blocks"), F.lit(0))).first()[0]
    heavy = (F.col("n_blocks") > HEAVY_BLOCKS) & (F.col("n_blocks") * HEAVY_PART > every)
    known = known.withColumn("parts", F.when(heavy, F.ceil(F.col("n_blocks") / HEAVY_BLOCKS)).otherwise(1).cast("int"))
    return known, (blocks if collection is None else blocks.where(inside))


def _joined(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """Requests' tokens with their blocks; a token of very many blocks meets them in parts."""
    heavy = asked.where("parts > 1").select("token", F.col("parts").alias("_parts")).distinct()  # fewer than HEAVY_PART tokens
    dealt = blocks.join(F.broadcast(heavy), "token", "left").withColumn("part", F.pmod("slot", F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    return asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(dealt, ["token", "part"])


def _postings(rows: DataFrame, keep: list[str], dead: DataFrame | None) -> DataFrame:
    """(keep, id, tf, len) of joined blocks, without removed passages."""
    each = rows.select(*keep, "at", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("lens").alias("len"))).alias("id", "tf", "len"))
    if dead is not None:
        gone = dead.select(F.col("id").alias("_id"), F.col("at").alias("_at"))
        each = each.join(gone, (F.col("id") == F.col("_id")) & (F.col("at") < F.col("_at")), "left_anti")
    return each.drop("at")


def _sums(rows: DataFrame, dead: DataFrame | None, before_self: bool, settings: Settings) -> DataFrame:
    """(request_id, id, score) over joined blocks."""
    each = _postings(rows, ["request_id", "mult", "idf", "avg_len"], dead)
    each = each.where("id < request_id") if before_self else each
    part = bm25_score(F.col("tf"), F.col("len"), F.col("avg_len"), F.col("idf"), settings) * F.col("mult")
    return each.groupBy("request_id", "id").agg(F.sum(part).alias("score"))


def _best(scored: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best rows of each request."""
    place = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("_r", place).where(F.col("_r") <= limit).drop("_r")


def _last_place(scored: DataFrame, limit: int) -> DataFrame:
    """(request_id, least): the score at place ``limit``, 0 where there are fewer."""
    return _best(scored, limit).groupBy("request_id").agg(F.when(F.count("*") == limit, F.min("score")).otherwise(0.0).alias("least"))


def _looked_up(pairs: DataFrame, asked: DataFrame, blocks: DataFrame, dead: DataFrame | None, settings: Settings) -> DataFrame:
    """(request_id, id, score): what each token of ``asked`` gives the pairs (request_id, id), a row for each that does."""
    wanted = pairs.select("request_id", "id").join(asked.select("request_id", "token", "mult", "idf", "avg_len"), "request_id").withColumn("slot", slot_of(F.col("id")))
    there = blocks.join(wanted.select("token", "slot").distinct(), ["token", "slot"], "left_semi")
    found = wanted.drop("slot").join(_postings(there, ["token"], dead), ["token", "id"])
    part = bm25_score(F.col("tf"), F.col("len"), F.col("avg_len"), F.col("idf"), settings) * F.col("mult")
    return found.select("request_id", "id", part.alias("score"))


def top_matches(
    requests: DataFrame, index: BlockIndex, limit: int, collection: str | None = None, before_self: bool = False, as_of: bool = False, settings: Settings = DEFAULTS
) -> DataFrame:
    """(request_id, id, score, rank): the passages that match any token, best first, ties by id; ``limit`` at most.

    ``before_self`` keeps ids below the request's alone. ``as_of`` scores with the statistics of the passages up to the one
    that asks; it needs an index without removed passages.
    """
    if as_of and index.dead is not None:
        raise ValueError("statistics of the moment need an index without removed passages; merge it first")
    asked, blocks = _asked(requests, index, collection, as_of, settings)
    if asked.count() > MANY:
        return best_in_cells(asked, _postings(blocks, ["token"], index.dead), limit, before_self, settings)
    by_request = W.partitionBy("request_id")
    rare = F.sum("here").over(by_request.orderBy("here", "token").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("here")
    seeds = asked.withColumn("_past", rare).where(F.col("_past") < SEEDS * limit).drop("_past")
    first = materialize(_best(_sums(_joined(seeds, blocks), index.dead, before_self, settings), limit))
    whole = _looked_up(first, asked, blocks, index.dead, settings).groupBy("request_id", "id").agg(F.sum("score").alias("score"))
    least = materialize(_last_place(whole, limit))
    gain = by_request.orderBy(F.desc(F.col("here") / F.col("bound")), "token")
    weak = F.sum("bound").over(gain.rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = asked.join(least, "request_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - ROOM)
    ranked = materialize(ranked.withColumns({"alone": weak >= F.col("least"), "all": F.sum("bound").over(by_request)}))
    near = _joined(ranked.where("alone"), blocks)
    own = bm25_score(F.col("max_tf"), F.col("min_len"), F.col("avg_len"), F.col("idf"), settings) * F.col("mult")
    found = _sums(near.where(F.col("all") - F.col("bound") + own >= F.col("least")), index.dead, before_self, settings)
    rest = ranked.where("not alone").groupBy("request_id").agg(F.sum("bound").alias("rest"))
    found = found.join(rest, "request_id", "left").withColumn("rest", F.coalesce("rest", F.lit(0.0)))
    found = materialize(found.join(ranked.select("request_id", "least").distinct(), "request_id").where(F.col("score") + F.col("rest") >= F.col("least")).drop("least"))
    last = _last_place(found, limit).withColumnRenamed("least", "last")
    kept = materialize(found.join(last, "request_id").where(F.col("score") + F.col("rest") >= F.col("last") - ROOM).select("request_id", "id", "score"))
    more = _looked_up(kept, ranked.where("not alone"), blocks, index.dead, settings)
    both = kept.unionByName(more)
    scored = both.groupBy("request_id", "id").agg(F.round(F.sum("score"), 9).alias("score"))
    order = by_request.orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("request_id", "id", "score", "rank")
