"""Url filter: a Bloom filter cascade over the corpus's own keys, in DataFrame functions only.

A rule is (host, path, verdict) and fits a url whose host is the rule's or a subdomain of it and whose path
starts with the rule's; the longest rule wins. Where none fits, the url is blocked if its host or a parent
domain is on the host list, else allowed.

Both lists become keys of one set. The complete key universe is every key that a url of the corpus can ask
for, so levels that alternately encode the listed keys and the false positives give exact answers and no
url is joined to a list. Lists of any length are handled: keys are dealt into segments of a bounded
number of bits, and each segment is one pass over the urls.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits nothing and is
allowed; empty tables give empty results; repeated rows are judged alike; an empty list lists nothing;
further columns of the input stay, but for ones named host, path, rule or verdict, which are replaced.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

Rule = tuple[str, str, str]
BITS_PER_KEY = 12
HASHES = 6
SEGMENT_WORDS = 1 << 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), string.ascii_uppercase, string.ascii_lowercase), part(2)


def _domains(host: Column) -> Column:
    """The host and its parent domains."""
    names = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))


def _keys(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Every key a url can ask for: domain and path prefix under either verdict, and the domain alone."""
    domains = F.when(host == "", F.array().cast("array<string>")).otherwise(_domains(host))
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]).cast("array<string>"), lambda x: x.isNotNull())

    def asks(domain: Column) -> Column:
        ruled = F.flatten(F.transform(heads, lambda head: F.array(*[F.concat(F.lit(f"{v}|"), domain, head) for v in ("allow", "block")])))
        return F.concat(ruled, F.array(F.concat(F.lit("list|"), domain)))

    return F.flatten(F.transform(domains, asks))


class _Level:
    """One Bloom filter: a table of one row that holds its bits as 64-bit words."""

    def __init__(self, keys: DataFrame, count: int, seed: int):
        self.seed, self.words = seed, max(1, math.ceil(count * BITS_PER_KEY / 64))
        zero = keys.sparkSession.range(self.words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        ones = keys.select(F.explode(F.array(*self.places(F.col("key")))).alias("at")).select(
            F.expr("at div 64").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits")
        )
        words = zero.unionByName(ones).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        row = words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
        self.table = settle(row.select(F.transform("w", lambda x: x["bits"]).alias("bits")))

    def places(self, key: Column) -> list[Column]:
        size = F.lit(self.words * 64).cast("long")
        first, step = F.xxhash64(key, F.lit(self.seed)), F.xxhash64(key, F.lit(-1 - self.seed))
        return [F.pmod(F.xxhash64(first, step, F.lit(i)), size) for i in range(HASHES)]

    def has(self, key: Column, bits: Column) -> Column:
        tests = [F.getbit(F.get(bits, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1 for at in self.places(key)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


class Cascade:
    """Alternate levels: listed keys, then the others that pass, then the listed ones that pass, and so on."""

    def __init__(self, keys: DataFrame):
        """keys: every key of the universe once, with a boolean ``listed``."""
        self.levels: list[_Level] = []
        sides = [keys.where("listed").select("key"), keys.where("not listed").select("key")]
        count = sides[0].count()
        while count and len(self.levels) < 64:
            level = _Level(sides[0], count, len(self.levels))
            self.levels.append(level)
            passed = sides[1].withColumn("_bits", level.table.scalar()).where(level.has(F.col("key"), F.col("_bits"))).select("key")
            sides = [settle(passed), sides[0]]
            count = sides[0].count()
        if count:
            raise RuntimeError("the cascade did not end; keys must be distinct")

    def attach(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_bits{i}": level.table.scalar() for i, level in enumerate(self.levels)})

    def detach(self, df: DataFrame) -> DataFrame:
        return df.drop(*[f"_bits{i}" for i in range(len(self.levels))])

    def holds(self, key: Column) -> Column:
        """Exact for keys of the universe; needs the columns of attach()."""
        out = F.lit(False)
        for i in reversed(range(len(self.levels))):
            out = self.levels[i].has(key, F.col(f"_bits{i}")) & ~out
        return out


def filter_urls(pages: DataFrame, rules: Sequence[Rule], hosts: DataFrame, url: str = "url", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Add host, path, rule and verdict to ``pages``. ``hosts`` has a string column ``host`` of blocked domains."""
    spark = pages.sparkSession
    host, path = url_parts(F.col(url))
    lengths = sorted({len(p) for _, p, _ in rules})
    asked = pages.withColumns({"host": host, "path": path})
    listed = [f"{v}|{h}{p}" for h, p, v in rules]
    names = hosts.where("host is not null and host <> ''").select(F.concat(F.lit("list|"), "host").alias("key"))
    names = names.unionByName(spark.range(1).select(F.explode(F.array(*map(F.lit, listed)).cast("array<string>")).alias("key")))
    universe = asked.select("host", "path").distinct().select(F.explode(_keys(F.col("host"), F.col("path"), lengths)).alias("key"))
    keys = settle(
        universe.select("key", F.lit(False).alias("listed"))
        .unionByName(names.select("key", F.lit(True).alias("listed")))
        .groupBy("key")
        .agg(F.max("listed").alias("listed"))
    )
    segments = max(1, math.ceil(keys.where("listed").count() * BITS_PER_KEY / 64 / segment_words))
    out = asked.withColumn("_hits", F.array().cast("array<string>"))
    dealt = lambda key: F.pmod(F.xxhash64(key, F.lit(7919)), F.lit(segments))
    for s in range(segments):
        cascade = Cascade(keys.where(dealt(F.col("key")) == s))
        found = F.filter(_keys(F.col("host"), F.col("path"), lengths), lambda k: (dealt(k) == s) & cascade.holds(k))  # noqa: B023
        out = cascade.detach(cascade.attach(out).withColumn("_hits", F.concat("_hits", found)))
        out = settle(out) if segments > 1 else out
    ruled = F.filter("_hits", lambda k: ~k.startswith("list|"))
    best = F.array_max(F.transform(ruled, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    return out.withColumn("_best", best).select(
        *[c for c in pages.columns if c not in ("host", "path", "rule", "verdict")],
        "host",
        "path",
        F.col("_best").substr(F.instr("_best", "|") + 1, F.length("_best")).alias("rule"),
        F.when(F.col("_best").isNotNull(), F.substring_index("_best", "|", 1))
        .when(F.exists("_hits", lambda k: k.startswith("list|")), "block")
        .otherwise("allow")
        .alias("verdict"),
    )
