"""Tokens, store, retrieval and graph on small rows."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.config import CONVERSATION, Settings
from tessera.functions import text as tx
from tessera.operators import graph, index, judging, recall, store
from tessera.schemas import EDGES, MEMORY, REQUESTS, TURNS


def tokens(spark, text, f=tx.index_tokens):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def memory(spark, rows):
    """rows: id, collection, source_id, text, cwd, session_id"""
    full = [(i, c, s, t, None, None, None, w, n, "user") for i, c, s, t, w, n in rows]
    return spark.createDataFrame(full, MEMORY).withColumn("sha256", F.sha2("text", 256))


def said(spark, *texts):
    return memory(spark, [(i + 1, CONVERSATION, "s", t, "/p", "n") for i, t in enumerate(texts)])


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), REQUESTS)


@pytest.mark.parametrize(
    "text,want",
    [
        ("tariff ledger", ["tariff", "ledger"]),
        ("ab漢字仮名c9", ["ab", "漢字", "字仮", "仮名", "c9"]),
        ("漢", ["漢"]),
        ("Naïve ÉCOLE straße", ["naive", "ecole", "straße"]),
        ("", []),
        ("!?", []),
        (None, []),
    ],
)
def test_index_tokens(spark, text, want):
    assert tokens(spark, text) == want


def test_query_keeps_the_last_tokens(spark):
    assert tokens(spark, " ".join(f"w{i}" for i in range(70)), tx.query_tokens) == [f"w{i}" for i in range(6, 70)]
    assert tokens(spark, "a a", tx.query_tokens) == ["a", "a"]


def test_estimates(spark):
    got = spark.createDataFrame([("",), ("abcde",), ("é",), ("😀😀😀",), (None,)], "t string").select(tx.estimate_tokens(F.col("t")), tx.estimate_tokens_utf16(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(0, 0), (2, 2), (1, 1), (3, 2), (0, 0)]


def test_flattened_content(spark):
    rows = ['"plain"', '[{"text":"a"},{"content":[{"text":"b"}]}]', '[{"type":"text","text":" x "},{"type":"toolCall","text":"y"}]', "5", None, "[]"]
    df = spark.createDataFrame([(r,) for r in rows], "c string")
    assert [r[0] for r in df.select(tx.text_of(F.col("c"))).collect()] == ["plain", "a\nb", " x \ny", "", "", ""]
    assert [r[0] for r in df.select(tx.assistant_prose(F.col("c"))).collect()][2] == "x"


def test_entry_sizes(spark):
    rows = [("message", '{"a":1}', None, None), ("compaction", None, "abcd", None), ("branch_summary", None, None, None), ("custom_message", None, None, '"xy"'), ("other", "zz", "zz", None)]
    df = spark.createDataFrame(rows, "type string, message_json string, summary string, content_json string")
    assert [r[0] for r in df.select(tx.entry_tokens(df)).collect()] == [2, 1, 0, 1, 0]


def turns(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], TURNS)


def test_ingest(spark):
    rows = [
        ("close on Tuesday", "assistant", "/a", "s1", None, False),
        ("close on Tuesday", "user", "/b", "s2", None, False),
        ("x", "toolResult", None, None, None, False),
        (" 　\n", "user", None, None, None, False),
        ("summary", "user", None, None, None, True),
        ("old text", "user", None, None, None, False),
        ("by default", None, None, None, "", False),
    ]
    known = said(spark, "old text")
    status = store.ingest_status(turns(spark, rows), known).orderBy("arrival").collect()
    assert [r.status for r in status] == ["stored", "duplicate", "ignored", "ignored", "refused", "duplicate", "stored"]
    assert [r.source_id for r in status][-1] == "manual" and status[-1].role == "user"
    new = store.assign_ids(store.ingest_new(turns(spark, rows), known), 10).orderBy("id").collect()
    assert [(r.id, r.text) for r in new] == [(11, "close on Tuesday"), (12, "by default")]
    other = known.withColumn("collection", F.lit("default"))
    assert store.ingest_new(turns(spark, rows), other, scope="collection").count() == 3
    runs = store.capture_summary(store.ingest_status(turns(spark, rows), known).fillna("-", ["session_id"])).collect()
    assert {r.session_id: (r.stored, r.ignored) for r in runs} == {"s1": (1, 0), "s2": (0, 1), "-": (1, 4)}


@pytest.mark.parametrize("parts", ["1", "8", "64"])
def test_ids_follow_arrival_at_any_partitioning(spark, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = spark.range(500).select((F.col("id") * 37 % 500).alias("arrival"))
        got = store.assign_ids(rows, 5).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert sorted((r.arrival, r.id) for r in got) == [(i, i + 6) for i in range(500)]


def test_sources_are_replaced_alone(spark):
    old = memory(spark, [(1, "d", "ledger", "one", "", ""), (2, "d", "other", "unrelated", "", ""), (3, "e", "ledger", "keep", "", "")])
    new = memory(spark, [(4, "d", "ledger", "a", "", ""), (5, "d", "ledger", "b", "", "")])
    assert sorted(r.id for r in store.replace_source(old, new).collect()) == [2, 3, 4, 5]
    assert sorted(r.id for r in store.replace_source(old, new.limit(0), new).collect()) == [2, 3]


def test_gate(spark):
    rows = [(1, "d", "filler", False), (2, "d", "keep", False), (3, "d", "sum", True), (4, "d", "none", False), (5, CONVERSATION, "c", False), (6, "d", "edge", False), (7, "d", "null", False)]
    marks = [(1, 0.2, "v"), (2, 0.91, "v"), (6, 0.75, "v"), (7, None, "v")]
    df = spark.createDataFrame(rows, "subject_id long, collection string, text string, is_summary boolean")
    got = store.gated_remember(df, spark.createDataFrame(marks, "subject_id long, probability double, model_version string")).orderBy("subject_id").collect()
    assert [(r.status, r.reason) for r in got] == [
        ("refused", "below_threshold"), ("stored", None), ("refused", "summary"), ("unavailable", None), ("ingest", None), ("stored", None), ("refused", "below_threshold")
    ]
    assert got[0].probability == 0.2 and got[1].model_version == "v"


def test_upserts_and_deletes(spark):
    edges = spark.createDataFrame([(2, 1, "related", 0.5), (3, 1, "related", 0.6)], EDGES)
    newer = spark.createDataFrame([(2, 1, "related", 0.1)], EDGES)
    assert {(r.src, r.probability) for r in store.upsert_edges(edges, newer).collect()} == {(2, 0.1), (3, 0.6)}
    rows = said(spark, "a b", "c", "d")
    postings, _, _ = index.build_index(rows)
    m, e, p = store.cascade_delete(rows, edges, postings, spark.createDataFrame([(2,)], "id long"))
    assert (sorted(r.id for r in m.collect()), [r.src for r in e.collect()], sorted({r.id for r in p.collect()})) == ([1, 3], [3], [1, 3])


def test_bm25_equals_the_full_text_engine(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    asked = ["the and inin", "the the licensed", "und der die", "tion"]
    lite = sqlite3.connect(":memory:")
    lite.execute("create virtual table f using fts5(t, tokenize='unicode61')")
    lite.executemany("insert into f(rowid, t) values (?, ?)", list(enumerate(docs, 1)))
    rows = said(spark, *docs)
    got = index.shortlist(ask(spark, *asked), rows, 20, CONVERSATION).collect()
    for i, q in enumerate(asked):
        match = " OR ".join(f'"{w}"' for w in q.split())
        want = [(r, -s) for r, s in lite.execute("select rowid, bm25(f) from f where f match ?", (match,))]
        want = sorted(((r, round(s, 9)) for r, s in want), key=lambda w: (-w[1], w[0]))[:20]
        mine = [(r.id, r.score) for r in sorted((r for r in got if r.request_id == i), key=lambda r: r["rank"])]
        assert [m[0] for m in mine] == [w[0] for w in want]
        assert all(math.isclose(m[1], w[1], abs_tol=1e-8) for m, w in zip(mine, want))


def test_shortlist(spark, monkeypatch):
    rows = said(spark, "tariff ledger alpha", "ferry pier", "之前在插件的开发")
    got = lambda *q: [(r.request_id, r.id) for r in index.shortlist(ask(spark, *q), rows, 5, CONVERSATION).orderBy("request_id", "rank").collect()]
    assert got("tariff", "zzz none", "插件开发", "", "pier " + "pad " * 70 + "ledger") == [(0, 1), (2, 3), (4, 1)]
    monkeypatch.setattr(index, "SLICE_TOKENS", 1)
    assert got("tariff", "pier", "alpha ferry") == [(0, 1), (1, 2), (2, 2), (2, 1)]
    assert index.shortlist(ask(spark, "tariff"), rows, 5, "default").count() == 0


def near(spark, seeds, edges, rows, limit=20):
    df = spark.createDataFrame([(0, s) for s in seeds], "request_id long, id long")
    return [(r.id, r.depth, r.score) for r in graph.neighborhood(df, spark.createDataFrame(edges, EDGES), rows, CONVERSATION, limit).orderBy("pos").collect()]


def test_neighbourhood(spark):
    rows = said(spark, "a", "b", "c", "d").unionByName(memory(spark, [(9, "durable", "s", "x", "", "")]))
    edges = [(2, 1, "related", 0.9), (2, 9, "related", 0.8)]
    assert [n[0] for n in near(spark, [1], edges, rows)] == [1, 2] and [n[0] for n in near(spark, [2], edges, rows)] == [2, 1]
    assert [n[0] for n in near(spark, [3], edges, rows)] == [3] and near(spark, [], edges, rows) == []
    # reached at one hop by a weak edge and at two by a strong one: least depth, best score
    edges = [(2, 1, "related", 0.5), (3, 1, "related", 0.9), (3, 2, "related", 0.8), (4, 3, "related", 0.95)]
    assert near(spark, [1], edges, rows) == [(1, 0, 1.0), (3, 1, 0.9), (2, 1, 0.8), (4, 2, 0.95)]
    assert [n[0] for n in near(spark, [4, 1, 2], edges, rows, 2)] == [1, 2]


def test_links(spark):
    rows = said(spark, "alpha tariff ledger", "tariff ledger update", "tariff ledger tweak")
    pairs = graph.link_candidates(rows.where("id > 1"), rows)
    assert {(r.src, r.dst) for r in pairs.collect()} == {(2, 1), (3, 1), (3, 2)}
    marks = [(2, 1, 0.9), (3, 1, 0.3), (3, 2, 0.3)]
    edges = lambda m: [(r.src, r.dst) for r in graph.link_edges(pairs, spark.createDataFrame(m, "src long, dst long, probability double")).collect()]
    assert edges(marks) == [(2, 1)]
    assert edges([(2, 1, 0.5), (3, 1, 0.9)]) == [(2, 1)]  # one pair of 3 is unjudged


def recalled(spark, rows, request, marks, budget=2000, edges=None):
    judged = spark.createDataFrame([(0, i, p) for i, p in marks], "request_id long, id long, probability double")
    collection = CONVERSATION
    edges = None if edges is None else spark.createDataFrame(edges, EDGES)
    out = recall.recall(ask(spark, request), rows, edges, judged, collection, budget).first()
    ranked, _ = recall.ranked_passages(ask(spark, request), rows, edges, judged, collection, budget)
    section = recall.section(ranked).first()
    return out, section.section if section else ""


def test_recall(spark):
    rows = memory(spark, [(1, CONVERSATION, "a", "alpha tariff ledger", "/proj/a", "x"), (2, CONVERSATION, "b", "beta tariff ledger", "/proj/b", "y"), (3, CONVERSATION, "c", "huge tariff " + "x" * 9000, "/", "z")])
    out, section = recalled(spark, rows.where("id < 3"), "tariff ledger", [(1, 0.2), (2, 0.8)])
    assert "beta" in section and "cwd:/proj/b" in section and "alpha" not in section and out.used_tokens > 0
    out, section = recalled(spark, rows, "tariff", [(1, 0.2), (2, 0.8), (3, 0.95)])
    assert section == "" and out.over_budget == ["c", "b"]
    out, section = recalled(spark, rows, "zzzz-no-such-token", [])
    assert out.status == "ok" and out.passages == [] and section == ""
    out, section = recalled(spark, rows, "tariff", [(1, 0.2), (2, 0.8)])
    assert section == "" and len(out.passages) == 3 and all(p.unranked and p.probability is None for p in out.passages)
    rows = said(spark, "alpha tariff ledger", "beta ferry pier schedule")
    out, section = recalled(spark, rows, "tariff", [(1, 0.1), (2, 0.9)], edges=[(2, 1, "related", 0.9)])
    assert [p.text for p in out.passages] == ["[session:n cwd:/p]\nbeta ferry pier schedule"] and "beta" in section


def test_recall_request(spark):
    rows = [(1, 0, "旧约定" * 30), (1, 1, " 退款窗口是十四天 "), (2, 0, "x" * 9999), (3, 0, "a"), (3, 1, " "), (3, 2, "b"), (4, 0, "")]
    df = spark.createDataFrame(rows, "session_id long, seq int, content string")
    got = {r.session_id: r.request for r in recall.recall_request(df, 6).collect()}
    assert got == {1: "退款窗口是十四天", 2: "x" * 9999, 3: "a\n\nb", 4: ""}


def test_judges(spark):
    pairs = spark.createDataFrame([(1, "a b", "b c"), (2, "a b", "b c"), (3, "!", "x")], "k long, request string, text string")
    assert [r.probability for r in judging.lexical_judge(pairs).orderBy("k").collect()] == [0.5, 0.5, None]
    got = judging.judge(pairs, lambda q, t: q.str.len() / 10.0).orderBy("k").collect()
    assert [r.probability for r in got] == [0.3, 0.3, 0.1]


def test_packing(spark):
    settings = Settings(token_limit=12000)
    texts = [(1, i, "x" * 24000) for i in range(3)] + [(2, 0, "y" * 90000), (2, 1, "z"), (3, 0, "b" * 46000), (3, 1, "c" * (4 * 10976 - 6)), (3, 2, "c" * (4 * 10976 - 5))]
    tools = spark.createDataFrame([(n, i, f"id{i}", t) for n, i, t in texts], "session_id long, seq int, id string, content string")
    got = judging.pack_tool_batches(tools, settings).orderBy("session_id", "seq").collect()
    # 46000 characters are under the judge's limit and over the batch's; with its id an output of 4 * 10976 - 6 still fits
    assert [(r.batch, r.judged) for r in got] == [(1, True), (2, True), (3, True), (1, False), (2, True), (1, False), (2, True), (3, False)]
    rows = [("a", "k1", 60000), ("a", "k2", 60000), ("a", "k3", 100), ("b", "k", 200000), ("b", "small", 10)]
    df = spark.createDataFrame(rows, "request_id string, key string, entry_bytes int").withColumn("state_bytes", F.lit(10))
    got = {(r.request_id, r.key): (r.batch, r.error) for r in judging.pack_questions(df, Settings(token_limit=25000)).collect()}
    assert got == {("a", "k1"): (1, None), ("a", "k2"): (2, None), ("a", "k3"): (2, None), ("b", "k"): (None, "budget"), ("b", "small"): (1, "budget")}
    size = spark.createDataFrame([("k", "a<b&")], "k string, t string").select(judging.question_bytes(F.col("k"), F.lit("noul").alias("type"), F.col("t").alias("instructions"))).first()[0]
    assert size == len('"k":{"type":"noul","instructions":"a\\u003cb\\u0026"}')


def test_answers(spark):
    body = '{"answers":{"keep":{"noul":0.4},"group":{"choice":"north","probability":0.8,"confidence":0.7},"grade":{"score":3,"probability":0.6},"bad":{}},"modelVersion":"v7"}'
    asked = [("r", 0, k, t) for k, t in (("keep", "noul"), ("group", "choice"), ("grade", "score"), ("bad", "noul"), ("gone", "score"))] + [("q", 0, "x", "noul")]
    questions = spark.createDataFrame(asked, "request_id string, batch int, key string, type string")
    got = {r.key: r for r in judging.parse_answers(spark.createDataFrame([("r", 0, body), ("q", 0, "<html>")], "request_id string, batch int, body string"), questions).collect()}
    assert (got["keep"].probability, got["group"].choice, got["group"].confidence, got["grade"].score) == (0.4, "north", 0.7, 3.0)
    assert {k for k, r in got.items() if r.error == "parse"} == {"bad", "gone", "x"} and got["bad"].probability is None and got["keep"].model_version == "v7"
    assert judging.validate_questions(spark.createDataFrame([("noul", " "), ("odd", "x"), ("score", "x")], "type string, instructions string")).where("error is null").count() == 1
