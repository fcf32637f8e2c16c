"""Tables around an external judge: validation, packing, parsing, merging, and the point where a scorer plugs in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DEFAULTS, Settings
from ..functions.text import blank_trim, estimate_tokens
from ..schemas import RESPONSE
from ..sources.shared import materialize
from .counted import cuttable, tokens_of

#: Groups of more rows than this are filled by many tasks, in segments of as many rows.
SEGMENT = 65536


def validate_questions(questions: DataFrame) -> DataFrame:
    """Add error: ``validation`` for an unknown type or blank instructions, else null."""
    fine = F.col("type").isin("noul", "choice", "score") & (blank_trim(F.coalesce("instructions", F.lit(""))) != "")
    return questions.withColumn("error", F.when(~F.coalesce(fine, F.lit(False)), "validation"))


def json_bytes(json: Column) -> Column:
    """Bytes of a JSON text once <, > and &, and the line and paragraph separators of Unicode, are six-byte escapes."""
    without = lambda chars: F.length(json) - F.length(F.translate(json, chars, ""))
    return F.octet_length(json) + 5 * without("<>&") + 3 * without("\u2028\u2029")


def question_bytes(key: Column, *fields: Column) -> Column:
    """Bytes of one ``"key":{...}`` entry of a request."""
    quoted = F.regexp_replace(F.to_json(F.struct(key.alias("k"))), r'^\{"k":|\}$', "")
    return json_bytes(quoted) + 1 + json_bytes(F.to_json(F.struct(*fields)))


def _rows_in_order(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[pa.RecordBatch, list, list, list]]:
    for rows in batches:
        yield rows, rows[group].to_pylist(), rows["cost"].to_pylist(), rows["room"].to_pylist()


def _filled(rows: DataFrame, group: str, order: str, segment: int = SEGMENT) -> DataFrame:
    """Rows (group, order, cost, room) with ``batch``, from 1, filled in order while the sum of costs stays within the room.

    A batch holds one row at least; a group has one room. Where a batch begins depends on all rows before it. A group of up to
    ``segment`` rows is walked through by one task that holds a number and a sum; a longer one is cut into segments that are
    walked through side by side (``_filled_in_segments``). Rows of a null group are one group; rows that tie in order are taken
    by cost. Empty input gives no rows.
    """
    rows = materialize(rows)
    long = materialize(rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") > segment).select(F.col(group).alias("_long")))
    if long.isEmpty():
        return _filled_by_group(rows, group, order)
    same = F.col(group).eqNullSafe(F.col("_long"))
    short = _filled_by_group(rows.join(long, same, "left_anti"), group, order)
    return short.unionByName(_filled_in_segments(rows.join(long, same, "left_semi"), group, order, segment))


def _filled_by_group(rows: DataFrame, group: str, order: str) -> DataFrame:
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number, total = None, 0, 0
        for rows, owners, costs, rooms in _rows_in_order(batches, group):
            out = []
            for own, cost, room in zip(owners, costs, rooms):
                if own != at or number == 0:
                    at, number, total = own, 1, cost
                elif total + cost > room:
                    number, total = number + 1, cost
                else:
                    total += cost
                out.append(number)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.int64())], schema.names)

    return rows.repartition(group).sortWithinPartitions(group, order, "cost").mapInArrow(fill, schema)


def _exits(costs: list[int], room: int) -> Iterator[tuple[int, int, int]]:
    """What a segment does to an open batch that holds t: (low, begun, open), of which the one with the largest low below t holds.

    The first row that breaks the batch is among those that fit into one room, so there are no more exits than that; equal
    neighbours are one. From each row, the next one that breaks is found by the running sums, and numbers of batches begun and the
    last one's first row follow from the segment's end on. begun = 0 means that all rows fit and open is added to t.
    """
    cost = np.asarray(costs, "int64")
    upto = np.cumsum(cost)
    before = upto - cost
    places = np.arange(len(cost))
    breaks = np.maximum(np.searchsorted(upto, before + room, side="right"), places + 1).tolist()
    begun, last = [1] * len(cost), list(range(len(cost)))
    for i in range(len(cost) - 1, -1, -1):
        if breaks[i] < len(cost):
            begun[i], last[i] = begun[breaks[i]] + 1, last[breaks[i]]
    total = int(upto[-1])
    if total <= room:
        yield -1, 0, total
    first, shown = min(int(np.searchsorted(upto, room, side="right")) + 1, len(cost)), None
    lows = np.maximum(room - upto[:first], -1).tolist()
    for j in range(first - 1, -1, -1):
        if j and lows[j - 1] == lows[j]:
            continue  # rows that cost nothing never break a batch that the row before them doesn't
        this = (begun[j], total - int(before[last[j]]))
        if this != shown:
            yield lows[j], *this
            shown = this


def _filled_in_segments(rows: DataFrame, group: str, order: str, segment: int) -> DataFrame:
    """``_filled`` for groups of very many rows, over many tasks.

    Rows are range-partitioned in order, so a group goes to as many tasks as it needs, and written with the segment each is in. A
    segment's exits say how an open batch comes out of it. One walk through a group's exits, which holds three numbers, gives
    what each segment starts with; then all segments are filled side by side.
    """
    names = rows.columns
    dealt_schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.LongType()) for c in ("_part", "_segment", "_place"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, number, place = TaskContext.get().partitionId(), None, 0, segment
        for rows in batches:
            numbers, places = [], []
            for own in rows[group].to_pylist():
                if own != at or place + 1 >= segment:
                    at, number, place = own, number + 1, 0
                else:
                    place += 1
                numbers.append(number)
                places.append(place)
            added = [pa.array([part] * len(numbers), pa.int64()), pa.array(numbers, pa.int64()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *added], dealt_schema.names)

    by = [group, order, "cost"]
    dealt = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(cut, dealt_schema))
    keys = ["_part", "_segment"]
    exit_schema = T.StructType([*(rows.schema[c] for c in (group, "room")), *(T.StructField(c, T.LongType()) for c in (*keys, "low", "begun", "open"))])

    def exits(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_place")
        own, room = rows[group][0].as_py(), rows["room"][0].as_py()
        found = [(own, room, key[0].as_py(), key[1].as_py(), *e) for e in _exits(rows["cost"].to_pylist(), room)]
        return pa.table({f.name: pa.array(list(c), to_arrow_type(f.dataType)) for f, c in zip(exit_schema.fields, zip(*found))})

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, where, total, number, out = None, None, 0, 0, None

        def leave():
            nonlocal total, number
            total, number = (total if out[0] == 0 else 0) + out[1], number + out[0]

        for rows in batches:
            starts = []
            for own, room, part, place, low, begun, left in zip(*(rows[c].to_pylist() for c in exit_schema.names)):
                if (part, place) != where:
                    if where is not None and own == at:
                        leave()
                    else:
                        at, total, number = own, room + 1, 0  # nothing is open: the first row begins a batch
                    where, out = (part, place), None
                    starts.append((part, place, total, number))
                if low < total:
                    out = (begun, left)
            if starts:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*starts)], [*keys, "total", "number"])

    found = dealt.select(group, "cost", "room", *keys, "_place").groupBy(*keys).applyInArrow(exits, exit_schema)
    starts = found.repartition(group).sortWithinPartitions(group, *keys, "low").mapInArrow(walk, "_part long, _segment long, total long, number long")
    # a segment's start is a row before its first one
    heads = starts.select(*keys, F.lit(-1).cast("long").alias("_place"), "total", "number")
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.LongType())])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = 0, 0
        for rows in batches:
            out, kept = [], []
            for place, cost, room, had, count in zip(*(rows[c].to_pylist() for c in ("_place", "cost", "room", "total", "number"))):
                kept.append(place >= 0)
                if place < 0:
                    total, number = had, count
                elif total + cost > room:
                    number, total = number + 1, cost
                    out.append(number)
                else:
                    total += cost
                    out.append(number)
            rows = rows.filter(pa.array(kept, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in names), pa.array(out, pa.int64())], schema.names)

    all_rows = dealt.unionByName(heads, allowMissingColumns=True)
    return all_rows.repartition(*keys).sortWithinPartitions(*keys, "_place").mapInArrow(fill, schema)


def pack_questions(questions: DataFrame, settings: Settings = DEFAULTS, segment: int = SEGMENT) -> DataFrame:
    """(request_id, key, batch, error) from request_id, key, entry_bytes and state_bytes.

    Keys in order fill batches whose estimated tokens stay within the limit. A question over it alone makes
    every key of its request fail with ``budget``.
    """
    frame = len('{"questions":{},"state":}')
    limit = settings.token_limit * 4  # ceil(bytes / 4) <= limit
    room = limit - frame - F.col("state_bytes").cast("long")
    # sizes are computed once, as three reads follow
    rows = materialize(questions.select("request_id", "key", F.col("entry_bytes").cast("long").alias("entry"), room.alias("room")))
    # each entry but a batch's first has a comma before it
    fits = rows.where("entry <= room").select("request_id", "key", (F.col("entry") + 1).alias("cost"), (F.col("room") + 1).alias("room"))
    failed = rows.where("entry > room").select("request_id").distinct().withColumn("error", F.lit("budget"))
    good = _filled(fits, "request_id", "key", segment).select("request_id", "key", "batch").join(failed, "request_id", "left")
    bad = rows.where("entry > room").select("request_id", "key", F.lit(None).cast("long").alias("batch"), F.lit("budget").alias("error"))
    return good.select("request_id", "key", "batch", "error").unionByName(bad)


def pack_tool_batches(eligible: DataFrame, settings: Settings = DEFAULTS, segment: int = SEGMENT) -> DataFrame:
    """(session_id, seq, batch, judged) of eligible tool outputs (id, content) in order.

    A batch is filled by each output's estimate and an overhead. It is judged as one text of all its outputs, each
    under its id and a blank line apart, and not at all if that text is over the same limit.
    """
    limit = max(settings.token_limit - settings.batch_slack, settings.batch_floor)
    cost = estimate_tokens(F.col("content")) + settings.item_overhead
    shown = F.octet_length(F.coalesce("id", F.lit(""))) + F.octet_length(F.coalesce("content", F.lit(""))) + len("[]\n") + len("\n\n")
    rows = eligible.select("session_id", "seq", cost.alias("cost"), F.lit(limit).cast("long").alias("room"), shown.cast("long").alias("shown"))
    packed = _filled(rows, "session_id", "seq", segment)
    size = F.sum("shown").over(W.partitionBy("session_id", "batch")) - len("\n\n")
    return packed.withColumn("judged", F.floor((size + 3) / 4) <= limit).select("session_id", "seq", "batch", "judged")


def parse_answers(responses: DataFrame, questions: DataFrame) -> DataFrame:
    """One row per question of a response's request: its answer, or error ``parse``."""
    body = F.from_json("body", RESPONSE)
    versions = [F.when(blank_trim(F.col(f"r.{c}")) != "", F.col(f"r.{c}")) for c in ("model_version", "modelVersion", "version", "model")]
    read = responses.withColumn("r", body).select("request_id", "batch", F.coalesce("r.answers", "r.questions").alias("found"), F.coalesce(*versions).alias("model_version"))
    rows = read.join(questions.select("request_id", "batch", "key", "type"), ["request_id", "batch"])
    rows = rows.withColumn("a", F.try_element_at("found", "key"))
    probability = F.when(F.col("type") == "noul", F.coalesce("a.noul", "a.probability")).otherwise(F.col("a.probability"))
    choice = F.when(F.col("type") == "choice", F.nullif("a.choice", F.lit("")))
    score = F.when(F.col("type") == "score", F.col("a.score"))
    present = F.when(F.col("type") == "noul", probability.isNotNull()).when(F.col("type") == "choice", choice.isNotNull()).otherwise(score.isNotNull())
    ok = F.coalesce(present, F.lit(False))
    shown = lambda c, name: F.when(ok, c).alias(name)
    return rows.select(
        "request_id", "batch", "key", "type", shown(probability, "probability"), shown(choice, "choice"), shown(score, "score"),
        shown(F.col("a.probabilities"), "probabilities"), shown(F.col("a.confidence"), "confidence"), "model_version", F.when(~ok, "parse").alias("error"),
    )


def merge_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(request_id, key, probability, model_version, error): a key twice, absent or in error fails its request."""
    per_key = answers.groupBy("request_id", "key").agg(F.count("*").alias("n"), F.first("probability").alias("probability"), F.max("error").alias("bad"))
    rows = questions.select("request_id", "key").join(per_key, ["request_id", "key"], "left")
    wrong = F.when(F.col("n") > 1, "duplicate").when(F.col("n").isNull(), "missing").otherwise(F.col("bad"))
    version = answers.where("model_version is not null").groupBy("request_id").agg(F.min_by("model_version", "batch").alias("model_version"))
    rows = rows.withColumn("error", F.max(wrong).over(W.partitionBy("request_id")))
    return rows.join(version, "request_id", "left").select("request_id", "key", F.when(F.col("error").isNull(), F.col("probability")).alias("probability"), "model_version", "error")


def _pair() -> Column:
    return F.sha2(F.concat_ws("\0", F.sha2(F.coalesce("request", F.lit("")), 256), F.sha2(F.coalesce("text", F.lit("")), 256)), 256)


def judge(pairs: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], partitions: int | None = None, kept: str | None = None, model_version: str = "") -> DataFrame:
    """Pairs (request, text and any keys) with a probability from a user's scorer, which sees each distinct pair once.

    With ``kept``, the path of a table of judgments, a pair that this model version has judged before is read there and is not
    scored again; new judgments are written before anything reads them. A null probability is a failure and is asked again.
    Without it the result is settled all the same: however often it is read, the scorer runs once.
    """
    keyed = pairs.withColumn("_pair", _pair())
    once = keyed.select("_pair", "request", "text").dropDuplicates(["_pair"])
    if kept:
        asked = keyed.select("_pair").distinct()
        known = materialize(read_judged(pairs.sparkSession, kept, model_version).join(asked, "_pair", "left_semi"))
        once = once.join(known, "_pair", "left_anti")
    once = once.repartition(partitions) if partitions else once

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"_pair": f["_pair"], "probability": scorer(f["request"], f["text"]).astype("float64")})

    scored = materialize(once.mapInPandas(run, "_pair string, probability double"))
    if kept:
        fine = scored.where("probability is not null").select("_pair", "probability", F.lit(model_version).alias("model_version"), F.substring("_pair", 1, 2).alias("bucket"))
        fine.repartition("bucket").write.mode("append").partitionBy("model_version", "bucket").parquet(kept)
        scored = scored.unionByName(known)
    return keyed.join(scored, "_pair").drop("_pair")


def read_judged(spark: SparkSession, path: str, model_version: str = "") -> DataFrame:
    """(_pair, probability) that a model version has given; of a pair that two jobs scored at once the smaller counts."""
    schema = "_pair string, probability double, model_version string, bucket string"
    try:
        rows = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return rows.where(F.col("model_version").eqNullSafe(F.nullif(F.lit(model_version), F.lit("")))).groupBy("_pair").agg(F.min("probability").alias("probability"))


def _common(request: pa.Array, request_tokens: pa.Array, text: pa.Array, tokens: pa.Array, most: int) -> tuple[pa.Array, pa.Array]:
    """How many of the distinct tokens among a request's last ``most`` the text has, and how many there are."""
    (row, asked, each), (own, has, _) = tokens_of(request, request_tokens), tokens_of(text, tokens)
    coded = pa.concat_arrays([asked, has]).dictionary_encode()
    code, n = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    order = np.argsort(row, kind="stable")
    row, mine = row[order], code[: len(asked)][order]
    after = np.repeat(np.cumsum(each), each) - np.arange(len(row))  # places up to the end of the request
    last = after <= most
    keys = np.unique(row[last] * n + mine[last])
    both = keys[np.isin(keys, own * n + code[len(asked) :])]
    count = lambda keys: pa.array(np.bincount(keys // n, minlength=len(request)).astype(np.int32))
    return count(both), count(keys)


def lexical_judge(pairs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pairs with the share of the request's distinct tokens that the text has; null without tokens."""
    sides = ["_request", "_request_tokens", "_text", "_text_tokens"]
    names = pairs.columns
    schema = T.StructType([*pairs.schema.fields, T.StructField("_common", T.IntegerType()), T.StructField("_asked", T.IntegerType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = _common(*(rows[c] for c in sides), settings.max_query_tokens)
            yield pa.RecordBatch.from_arrays([*(rows[c] for c in names), *found], schema.names)

    ready = pairs.withColumns(dict(zip(sides, (*cuttable(F.col("request")), *cuttable(F.col("text"))))))
    share = F.col("_common") / F.nullif(F.col("_asked"), F.lit(0))
    return ready.mapInArrow(count, schema).withColumn("probability", F.round(share, 9)).drop("_common", "_asked")
