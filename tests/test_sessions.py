"""Messages, compaction, host windows, sources and streams on small rows; running sums against plain loops."""

import json
import random
import shutil

from pyspark.sql import functions as F

from tessera.config import CONVERSATION, DEFAULTS, Settings
from tessera.functions import text as tx
from tessera.operators import compact, host_window, index, judging, messages
from tessera.schemas import ELISIONS, MEMORY
from tessera.sources import tables
from tessera.streaming import streams

SAID = "session_id long, seq int, id string, role string, kind string, content string"
ENTRIES = "session_id long, seq int, id string, type string, message_json string, summary string, content_json string"
PREPARATION = "session_id long, first_kept_entry_id string, tokens_before long, reserve_tokens int, keep_recent_tokens int, context_window int"


def session(spark, *rows, number=1):
    """rows: kind, content"""
    roles = {"prefix": "system", "tool": "tool"}
    return spark.createDataFrame([(number, i, f"m{i}", roles.get(k, "user"), k, c) for i, (k, c) in enumerate(rows)], SAID)


def marks(spark, rows):
    return spark.createDataFrame([(1, s, p) for s, p in rows], "session_id long, seq int, probability double")


def test_elision(spark):
    said = session(spark, ("prefix", "FROZEN"), ("tool", "old body"), ("tool", "keep body"), ("tool", "tail"))
    settings = Settings(pressure_ratio=0.0, protected_tail_tokens=1)
    rows, payloads = compact.elide(said, marks(spark, [(1, 0.1), (2, 0.25)]), settings=settings)
    got = rows.orderBy("seq").collect()
    assert [r.elided for r in got] == [False, True, False, False] and got[1].content == DEFAULTS.pointer_format % got[1].pointer
    assert {r.status for r in got} == {"compacted"}
    pages = {r.page: bytes(r.data) for r in compact.pages(payloads, 4).collect()}
    assert pages == {0: b"old ", 1: b"body"}
    asked = spark.createDataFrame([(got[1].pointer, 1), (got[1].pointer, -3), (got[1].pointer, 9), ("e:missing", 0)], "pointer string, page int")
    assert [(r.found, r.data and bytes(r.data)) for r in compact.expand(asked, payloads, 4).orderBy(F.desc("found"), "page").collect()] == [(True, b"old "), (True, b"body"), (True, bytearray()), (False, None)]
    rows, payloads = compact.elide(said, marks(spark, [(1, 0.1)]), settings=settings)
    assert {r.status for r in rows.collect()} == {"fallback"} and payloads.count() == 0 and rows.where("elided").count() == 0
    empty = spark.createDataFrame([("e:x", bytearray(), "h")], ELISIONS)
    assert [(r.page, bytes(r.data)) for r in compact.pages(empty, 4).collect()] == [(0, b"")]


def test_large_last_output_is_not_protected(spark):
    said = session(spark, ("tool", "KEEP-THIS"), ("tool", "H" * 4000))
    got = compact.eligible_tools(said, settings=Settings(pressure_ratio=0.0, protected_tail_tokens=10)).collect()
    assert sorted(r.seq for r in got) == [0, 1]


def test_protected_tail_equals_the_loop(spark):
    rng, rows, want = random.Random(1), [], set()
    for s in range(300):
        items = [("" if rng.random() < 0.3 else "x" * rng.randint(1, 40), rng.choice(["tool", "tool", "prose"])) for _ in range(rng.randint(0, 9))]
        left = 12
        rows += [(s, i, "i", "r", k, c) for i, (c, k) in enumerate(items)]
        for i in range(len(items) - 1, -1, -1):
            if items[i][1] != "tool":
                continue
            cost = (len(items[i][0]) + 3) // 4
            if left <= 0 or cost > left:
                break
            want.add((s, i))
            left -= cost
    got = compact.protected_tail(spark.createDataFrame(rows, SAID), 12)
    assert {(r.session_id, r.seq) for r in got.where("protected").collect()} == want


def test_pressure(spark):
    df = spark.createDataFrame([(1, 100, 1000), (2, 100, 5), (3, 20800, None), (4, 20799, 0)], "session_id long, used_tokens long, host_budget int")
    assert [r.under_pressure for r in compact.pressure(df).orderBy("session_id").collect()] == [False, True, True, False]


def test_fresh_window(spark):
    said = session(spark, ("prefix", "FROZEN"), ("prose", "old prose"), ("prefix", "late"))
    pointers = spark.createDataFrame([(1, 5, "e:abc")], "session_id long, seq int, pointer string")
    passages = spark.createDataFrame([(1, "notes", "body", 0.9, 1), (1, "also", "body", 0.9, 2)], "session_id long, source_id string, text string, probability double, nth long")
    pinned = spark.createDataFrame([(1, 0, "ship on Tuesday")], "session_id long, seq int, content string")
    got = compact.fresh_window(said, pointers, passages, pinned).first()
    assert [(w.id, w.kind) for w in got.window] == [("m0", "prefix"), ("pin-0", "pinned"), ("e:abc", "pointer"), ("mem-also", "memory"), ("mem-notes", "memory")]
    assert got.injection == [DEFAULTS.pointer_format % "e:abc", "[source:also]\nbody", "[source:notes]\nbody"]
    big = spark.createDataFrame([(1, "huge", "y" * 80, 0.9, 1), (1, "small", "y", 0.5, 2)], passages.schema)
    got = compact.fresh_window(said, pointers.limit(0), big, settings=Settings(token_budget=2)).first()
    assert got.over_budget == ["huge", "small"] and got.used_tokens == 2


def test_prepared_plan(spark):
    said = session(spark, ("prefix", "FROZEN"), ("prose", "refund"))
    memory = spark.createDataFrame([(i, CONVERSATION, s, t, None, None, None, "", "", "user") for i, s, t in ((1, "a", "alpha refund policy"), (2, "b", "beta shipping dock"))], MEMORY)
    edges = spark.createDataFrame([(2, 1, "related", 0.9)], "src long, dst long, kind string, probability double")
    judged = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.9)], "request_id long, id long, probability double")
    budgets = spark.createDataFrame([(1, 100)], "session_id long, host_budget int")
    got = compact.prepare(said, memory, edges, marks(spark, []), judged, budgets).first()
    assert got.status == "compacted" and got.budget == 100 and got.context == ["[source:b]\n[session: cwd:]\nbeta shipping dock"]


def test_normalised_messages(spark):
    listed = [
        {"kind": "tool", "content": "c", "id": ""},
        7,
        {"role": "system", "content": "rules"},
        {"info": {"role": "assistant", "id": "x"}, "parts": [{"text": "hi"}, {"type": "tool", "output": "out", "callID": "c1"}, 5, {"type": "tool-result", "content": "r"}]},
        {"parts": []},
        {"text": "only text", "id": 5},
    ]
    rows = [(1, json.dumps({"messages": listed})), (2, json.dumps({"data": [{"content": "d"}]})), (3, "no json"), (4, "{}")]
    got = messages.normalize_messages(spark.createDataFrame(rows, "session_id long, payload string")).orderBy("session_id", "seq", "part").collect()
    assert [(r.seq, r.id, r.role, r.kind, r.content) for r in got] == [
        (0, "0", "user", "tool", "c"), (2, "2", "system", "prefix", "rules"), (3, "x-0", "assistant", "prose", "hi"), (3, "c1", "tool", "tool", "out"),
        (3, "x-3", "tool", "tool", "r"), (5, "5", "user", "prose", "only text"), (0, "0", "user", "prose", "d"),
    ]


def test_preparation_messages(spark):
    m = lambda **k: json.dumps(k)
    first = [m(role="system", content="frozen rules"), "null", m(role="toolResult", toolCallId="call-1", content=[{"type": "text", "text": "body"}])]
    df = spark.createDataFrame([(1, first, [m(role="user", content=[{"text": "keep going"}])])], "session_id long, to_summarize array<string>, turn_prefix array<string>")
    got = messages.messages_from_preparation(df).orderBy("seq").collect()
    assert [(r.id, r.kind, r.role, r.content) for r in got] == [("m0", "prefix", "system", "frozen rules"), ("call-1", "tool", "tool", "body"), ("m2", "prose", "user", "keep going")]


def test_turns_of_a_session(spark):
    m = lambda **k: json.dumps(k, ensure_ascii=False)
    said = [
        m(role="user", content="约定"), m(role="assistant", content=[{"type": "text", "text": "ok"}, {"type": "toolCall", "name": "x"}]),
        m(role="toolResult", content="t"), m(role="assistant", content=[{"type": "text", "text": " "}]), m(role="user", content=""),
    ]
    rows = [(1, i, f"e{i}", "message", t, None, None) for i, t in enumerate(said)] + [(1, 9, "c", "compaction", None, "s", None)]
    got = messages.session_turns(spark.createDataFrame(rows, ENTRIES)).orderBy("seq").collect()
    assert [(r.role, r.content) for r in got] == [("user", "约定"), ("assistant", "ok")]
    last = session(spark, ("prose", "first"), ("prose", "last"), ("prose", ""), ("tool", "t"))
    assert messages.last_user_text(last).first().request == "last"


def log(spark, *rows, number=1):
    """rows: id, content of a user message"""
    return spark.createDataFrame([(number, i, n, "message", json.dumps({"role": "user", "content": c}), None, None) for i, (n, c) in enumerate(rows)], ENTRIES)


def prepared(spark, first, window, reserve=100, number=1):
    return spark.createDataFrame([(number, first, 5, reserve, None, window)], PREPARATION)


def plan(spark, status="compacted", context=("note",)):
    return spark.createDataFrame([(1, status, list(context))], "session_id long, status string, context array<string>")


def test_cut_moves_past_a_large_entry(spark):
    entries = log(spark, ("u1", "question"), ("t1", "y" * 8000), ("a1", "ok"))
    got = host_window.plan_compaction(prepared(spark, "u1", 1000), entries, plan(spark)).first()
    assert (got.first_kept_entry_id, got.fresh_cut, got.summary) == ("a1", True, "note")
    cut = host_window.deepened_cut(prepared(spark, "u1", 1000), entries, 10)
    assert cut.first().cut == "a1"
    base = prepared(spark, "u1", 1000).withColumns({"to_summarize": F.array().cast("array<string>"), "turn_prefix": F.array().cast("array<string>")})
    got = host_window.messages_for_compaction(base, entries, cut).orderBy("part", "seq").collect()
    assert [(r.id, len(r.content)) for r in got] == [("m0", 8), ("m1", 8000)]
    fits = host_window.plan_compaction(prepared(spark, "a1", 1000), entries, plan(spark)).first()
    assert (fits.first_kept_entry_id, fits.fresh_cut) == ("a1", False)


def test_nothing_fits(spark):
    entries = log(spark, ("u1", "z" * 5000))
    got = host_window.plan_compaction(prepared(spark, "u1", 1000), entries, plan(spark).limit(0)).first()
    assert (got.first_kept_entry_id, got.summary, got.fresh_cut) == (DEFAULTS.window_id, DEFAULTS.window_line, True)
    assert host_window.plan_compaction(prepared(spark, "u1", 262144, None), log(spark, ("u1", "s")), plan(spark, "fallback", ())).count() == 0
    assert host_window.host_budget(prepared(spark, "u1", 50)).first().budget == DEFAULTS.keep_recent_tokens


def test_cut_equals_the_loop(spark):
    rng, rows, limits, want = random.Random(2), [], [], {}
    for s in range(200):
        costs = [rng.randint(0, 9) for _ in range(rng.randint(0, 8))]
        summary, budget = rng.randint(0, 12), rng.randint(-1, 25)
        ids = [f"e{i}" if rng.random() < 0.9 else None for i in range(len(costs))]
        rows += [(s, i, n, "compaction", None, "x" * (4 * c), None) for i, (n, c) in enumerate(zip(ids, costs))]
        limits.append((s, summary, budget))
        kept, first = 0, None
        if budget > 0 and summary <= budget:
            for n, c in reversed([(n, c) for n, c in zip(ids, costs) if n]):
                if summary + kept + c > budget:
                    break
                kept, first = kept + c, n
        want[s] = (first, kept if first else 0)
    got = host_window.select_fresh_cut(spark.createDataFrame(rows, ENTRIES), spark.createDataFrame(limits, "session_id long, summary_tokens int, budget int"))
    assert {r.session_id: (r.first_kept, r.kept_tokens) for r in got.collect()} == want


def test_fitted_summary(spark):
    df = spark.createDataFrame([("aaaa\n\nbbbb\n\nc", 3), ("aaaa\n\nbbbb", 9), ("aaaa\n\nbbbbbbbb\n\nc", 3), ("", 5), ("long text", 0)], "s string, b int")
    assert [r[0] for r in df.select(host_window.fit_summary(F.col("s"), F.col("b"))).collect()] == ["aaaa\n\nbbbb", "aaaa\n\nbbbb", "aaaa", "", ""]


def test_sources(spark, tmp_path):
    payload = {"cwd": "/a", "session_id": "s", "messages": [{"role": "user", "content": "x"}, {"role": "user", "content": "y", "generated_summary": True}]}
    (tmp_path / "capture.json").write_text(json.dumps(payload) + "\n")
    got = tables.read_turns(spark, str(tmp_path / "capture.json")).orderBy("place").collect()
    assert [(r.text, r.generated_summary, r.source_id) for r in got] == [("x", False, None), ("y", True, None)]
    memory = spark.createDataFrame([(1, "d", "s", "t", "h", None, None, "", "", ""), (2, "e", "s", "u", "h", 0.5, "v", "", "", "")], MEMORY)
    tables.write_memory(memory, str(tmp_path / "memory"))
    assert [r.id for r in tables.read_memory(spark, str(tmp_path / "memory"), "e").collect()] == [2]
    plans = spark.createDataFrame([("ok", ["a"], []), ("ok", [], ["s"])], "status string, context array<string>, over_budget array<string>")
    tables.write_plans(plans, str(tmp_path / "plans"))
    docs = [json.loads(line) for p in sorted((tmp_path / "plans").glob("*.json")) for line in p.read_text().splitlines()]
    assert sorted("over_budget" in d for d in docs) == [False, True]
    (tmp_path / "texts.json").write_text(json.dumps({"source_id": "p", "texts": ["b", "a"]}))
    assert [r.text for r in tables.read_text_sources(spark, str(tmp_path / "texts.json"), "d").orderBy("place").collect()] == ["b", "a"]


def test_captured_twice_is_stored_once(spark, tmp_path):
    schema = "arrival long, text string, role string, cwd string, session_id string, source_id string, generated_summary boolean"
    rows = [(1, "alpha refund policy"), (2, "refund policy update"), (3, "alpha refund policy")]
    inbox, store_at, edges_at = (str(tmp_path / n) for n in ("in", "memory", "edges"))

    def deliver(batch):
        df = spark.createDataFrame([(i, t, "user", "", "s", None, False) for i, t in batch], schema)
        df.coalesce(1).write.mode("append").json(inbox)
        streams.capture_stream(spark.readStream.schema(schema).json(inbox), store_at, edges_at, str(tmp_path / "check")).awaitTermination(120)

    deliver(rows)
    deliver([*rows, (4, "policy update refund again")])
    memory = tables.read_memory(spark, store_at).orderBy("id").collect()
    assert [(r.id, r.text) for r in memory] == [(1, rows[0][1]), (2, rows[1][1]), (3, "policy update refund again")]
    edges = {(r.src, r.dst) for r in tables.read_edges(spark, edges_at).collect()}
    assert (2, 1) in edges and (3, 2) in edges
    requests, out = str(tmp_path / "asked"), str(tmp_path / "out")
    spark.createDataFrame([(7, "refund policy")], "request_id long, request string").write.json(requests)
    stream = spark.readStream.schema("request_id long, request string").json(requests)
    streams.recall_stream(stream, store_at, edges_at, out, str(tmp_path / "check2")).awaitTermination(120)
    got = spark.read.parquet(out).collect()
    assert got[0].request_id == 7 and "alpha refund policy" in got[0].section


def test_output_over_the_judges_limit_makes_its_session_fall_back(spark):
    settings = Settings(token_budget=1000, protected_tail_tokens=10, token_limit=5600)  # batches of 4576 tokens
    small, between = "s" * 8000, "b" * 20000  # 2000 and 5000 tokens; the second is under the judge's limit, not under the batch's
    rows = [(n, i, f"t{i}", "tool", "tool", text) for n, texts in ((1, [small, small, "end" * 40]), (2, [small, between, "end" * 40])) for i, text in enumerate(texts)]
    said = spark.createDataFrame(rows, SAID)
    marks = said.select("session_id", "seq", F.lit(0.1).alias("probability"))
    done, kept = compact.elide(said, marks, settings=settings)
    assert {(r.session_id, r.status, r.elided) for r in done.where("seq < 2").collect()} == {(1, "compacted", True), (2, "fallback", False)}
    assert kept.count() == 2  # the two small ones have one pointer
    free, _ = compact.elide(said, marks, settings=Settings(token_budget=1000, protected_tail_tokens=10, judge_has_cap=False))
    assert all(r.elided for r in free.where("seq < 2").collect())


def _passages(spark, rows):
    return spark.createDataFrame(rows, "id long, collection string, text string")


def test_many_slices_give_the_same_shortlist(spark, monkeypatch):
    rows = _passages(spark, [(i, "default", f"word{i % 3} word{i % 5} rest{i}") for i in range(40)])
    asked = spark.createDataFrame([(i, f"word{i % 3} rest{i} rest{i + 1}") for i in range(30)], "request_id long, request string")
    want = index.shortlist(asked, rows, 4).orderBy("request_id", "rank").collect()
    for tokens, slices in ((20, 8), (20, 1)):
        monkeypatch.setattr(index, "SLICE_TOKENS", tokens)
        monkeypatch.setattr(index, "MAX_SLICES", slices)
        assert index.shortlist(asked, rows, 4).orderBy("request_id", "rank").collect() == want


def test_recall_stream_without_a_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"request_id": 1, "request": "anything"}')
    stream = spark.readStream.schema("request_id long, request string").json(str(tmp_path / "in"))
    where = [str(tmp_path / x) for x in ("store", "edges", "out", "check")]
    streams.recall_stream(stream, *where).awaitTermination(120)
    assert spark.read.schema("request_id long, section string").parquet(where[2]).count() == 0


def test_text_of_nested_content(spark):
    deep = '"end"'
    for _ in range(6):
        deep = '[{"type": "text", "content": ' + deep + "}, {}]"
    rows = [('"[1, 2]"', "[1, 2]"), ('[{"content": "[3]"}, 4, {"text": "a"}]', "[3]\na"), (deep, "end"), ('{"text": "x"}', ""), (None, ""), ("[]", ""), ('[{"text": "", "content": "c"}]', "")]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, want string")
    got = got.withColumn("text", tx.text_of(F.col("c"))).orderBy("i").collect()
    assert [r.text for r in got] == [r.want for r in got]


def test_compaction_stream(spark, tmp_path):
    entries = log(spark, ("u1", "question"), ("t1", "y" * 8000), ("a1", "ok"))
    schema = PREPARATION + ", to_summarize array<string>, turn_prefix array<string>"
    event = {"session_id": 1, "first_kept_entry_id": "u1", "tokens_before": 5, "reserve_tokens": 100, "context_window": 1000, "to_summarize": ['{"role":"system","content":"rules"}']}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "e.json").write_text(json.dumps(event))
    memory, edges = spark.createDataFrame([], MEMORY), spark.createDataFrame([], "src long, dst long, kind string, probability double")
    judged = spark.createDataFrame([], "request_id long, id long, probability double")
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    none = lambda said: said.select("session_id", "seq", F.lit(0.9).alias("probability"))
    streams.compact_stream(stream, entries, memory, edges, none, judged, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.first_kept_entry_id, r.fresh_cut) for r in got] == [("a1", True)] and got[0].summary == DEFAULTS.window_line


def test_long_groups_are_filled_in_segments(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for group, n, cost, room in ((None, 300, lambda: rng.randint(1, 40), 100), ("even", 500, lambda: 10, 95), ("wide", 400, lambda: rng.randint(1, 3), 500), ("odd", 350, lambda: rng.choice([1, 2, 400]), 60), ("short", 5, lambda: 50, 60), ("nil", 200, lambda: rng.choice([0, 0, 7]), 20)):
        number, total = 0, room + 1
        for i in range(n):
            c = cost()
            number, total = (number + 1, c) if total + c > room else (number, total + c)
            rows.append((group, i, c, room))
            expected[group, i] = number
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "owner string, at int, cost long, room long").repartition(3)
    for segment in (16, 130, 10**6):
        got = judging._filled(df, "owner", "at", segment)
        assert got.columns == ["owner", "at", "cost", "room", "batch"]
        got = got.collect()
        assert len(got) == len(rows) and {(r.owner, r.at): r.batch for r in got} == expected
    assert judging._filled(df.limit(0), "owner", "at").collect() == []


def test_exits_of_a_segment_say_what_walking_through_it_says():
    rng = random.Random(11)
    for _ in range(300):
        room, costs = rng.randint(0, 30), [rng.randint(0, 12) for _ in range(rng.randint(1, 25))]
        found = list(judging._exits(costs, room))
        for t in range(room + 14):
            total, number = t, 0
            for c in costs:
                number, total = (number + 1, c) if total + c > room else (number, total + c)
            low, begun, left = max(f for f in found if f[0] < t)
            assert (begun, left + (t if begun == 0 else 0)) == (number, total)
