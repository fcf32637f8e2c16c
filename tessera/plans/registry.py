"""Registered queries over the driver tables and their SQL oracles."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CONVERSATION, DEFAULTS
from ..functions import text as tx
from ..operators import compact, graph, hash_table, host_window, index, judging, kept_index, kept_store, messages, recall, store
from ..sources import tables
from ..sources.shared import materialize, shared_dir
from ..streaming import streams
from . import views
from .oracles import ORACLES  # noqa: F401
from .views import TIGHT, table



def _ids(rows: DataFrame) -> DataFrame:
    return store.assign_ids(rows).select("id", "arrival", "source_id", "sha256", "session_id", "role")


def token_estimates(spark, d):
    rows = table(spark, d, "documents")
    return rows.select("doc_id", tx.estimate_tokens(F.col("text")).alias("tokens"), tx.estimate_tokens_utf16(F.col("text")).alias("tokens_utf16"))


def content_pointers(spark, d):
    rows = table(spark, d, "pages")
    pointer = tx.pointer_for(F.col("html"))
    return rows.select("page_id", tx.content_hash(F.col("html")).alias("sha256"), pointer.alias("pointer"), tx.pointer_line(pointer).alias("line"))


def label_passages(spark, d):
    rows = views.memory(spark, d)
    return rows.select("id", F.sha2(tx.label_passage(F.col("collection"), F.col("text"), F.col("session_id"), F.col("cwd")), 256).alias("label_sha256"))


def session_tokens(spark, d):
    return compact.session_tokens(views.session_messages(spark, d))


def classify_turns(spark, d):
    return messages.classify_turns(views.turns(spark, d)).select("arrival", "role", "source_id", "status", "reason")


def ingest_new(spark, d):
    known = views.memory(spark, d).where(F.col("collection") == "default")
    return _ids(store.ingest_new(views.repeated_turns(spark, d), known))


def ingest_kept(spark, d):
    """Against the kept hashes of all documents and of every third conversation, half of which were removed again."""
    rows, at = views.memory(spark, d), _folder(spark)
    said, conv = rows.where(F.col("collection") == CONVERSATION), "(id - 1000000000) div 1000"
    hash_table.follow_hashes(rows.where(F.col("collection") == "default"), at)
    for batch, part in (("turns", "% 3 = 0"), ("turns", "% 3 = 0")):
        hash_table.add_hashes(said.where(conv + part), at, batch)
    hash_table.add_hashes(said.where(f"{conv} % 6 = 0"), at, "gone", removed=True)
    return store.ingest_new(views.repeated_turns(spark, d), rows.limit(0), hashes=at).select("arrival", "source_id", "sha256", "session_id", "role")


def capture_summary(spark, d):
    known = views.memory(spark, d).where(F.col("collection") == "default")
    return store.capture_summary(store.ingest_status(views.repeated_turns(spark, d), known))


def _replaced(spark, rows):
    new = rows.where("source_id in ('src1', 'src2')").withColumn("id", F.col("id") + 10**10)
    return new, spark.range(1).select(F.lit("default").alias("collection"), F.lit("src3").alias("source_id"))


def replace_source(spark, d):
    rows = views.memory(spark, d)
    return store.replace_source(rows, *_replaced(spark, rows)).select("id", "collection", "source_id", "sha256")


def replace_stored(spark, d):
    """In a store whose folders are rewritten in place."""
    rows, at = views.memory(spark, d), _folder(spark)
    tables.write_memory(rows, at)
    new, gone = _replaced(spark, rows)
    kept_store.replace_stored(new, at, gone)
    return tables.read_memory(spark, at).select("id", "collection", "source_id", "sha256")


def gated_remember(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("subject_id"), F.lit("default").alias("collection"), "text", (F.col("doc_id") % 17 == 0).alias("is_summary"))
    marks = table(spark, d, "labels").select(F.col("doc_id").alias("subject_id"), F.when(F.col("quality") == 1, 0.9).otherwise(0.2).alias("probability"), F.lit("v1").alias("model_version"))
    return store.gated_remember(rows, marks).select("subject_id", "status", "reason", "probability", "model_version")


def count_memory(spark, d):
    return store.count_memory(views.memory(spark, d))


def memory_rows(spark, d):
    return store.memory_rows(views.memory(spark, d), CONVERSATION).select("id", "source_id", "sha256", "cwd", "session_id", "role")


def upsert_edges(spark, d):
    old = views.chain_edges(spark, d)
    new = old.where("probability < 0.5").withColumn("probability", 1 - F.col("probability"))
    return store.upsert_edges(old, new).select("src", "dst", "kind", F.round("probability", 6).alias("probability"))


def upsert_elisions(spark, d):
    rows = table(spark, d, "pages").select(tx.pointer_for(F.col("html")).alias("pointer"), F.col("html").cast("binary").alias("original"), F.sha2("html", 256).alias("sha256"))
    return store.upsert_elisions(rows, rows).select("pointer", F.octet_length("original").alias("n_bytes"), "sha256")


def cascade_delete(spark, d):
    rows, edges = views.memory(spark, d).where(F.col("collection") == CONVERSATION), views.chain_edges(spark, d)
    postings, _, _ = index.build_index(rows)
    kept = store.cascade_delete(rows, edges, postings, rows.where("role = 'assistant'").select("id"))
    parts = [df.select(F.lit(name).alias("part"), F.col(col).alias("id")) for name, col, df in zip(("memory", "edges", "postings"), ("id", "src", "id"), kept)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("part", "id").agg(F.count("*").alias("n"))


def index_tokens(spark, d):
    tokens = tx.index_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.sha2(F.array_join(tokens, " "), 256).alias("tokens_sha256"))


def build_index(spark, d):
    _, token_df, stats = index.build_index(views.memory(spark, d))
    return token_df.withColumns({"n_docs": stats.select("n_docs").scalar(), "avg_len": F.round(stats.select("avg_len").scalar(), 6)})


def shortlist_bm25(spark, d):
    found = index.shortlist(views.requests(spark, d), views.memory(spark, d), collection="default")
    return found.select("request_id", "id", F.round("score", 6).alias("score"), "rank")


def kept_shortlist(spark, d):
    """From a kept index that took in documents, then the turns, lost one source and had another replaced."""
    rows, at = views.memory(spark, d), _folder(spark)
    docs = rows.where(F.col("collection") == "default")
    for batch, part in (("documents", docs), ("turns", rows), ("turns", rows)):
        kept_index.append_index(part, at, batch)
    old = docs.where("source_id = 'src2'")
    new = old.withColumns({"id": F.col("id") + 10**10, "text": F.concat("text", F.lit(" once again"))})
    kept_index.remove_index(docs.where("source_id = 'src1'"), at, "gone")
    kept_index.replace_index(old, new, at, "replaced")
    found = index.shortlist(views.requests(spark, d), rows, collection="default", index=kept_index.open_index(spark, at))
    return found.select("request_id", "id", F.round("score", 6).alias("score"), "rank")


def links_of_the_moment(spark, d):
    rows = views.memory(spark, d)
    found = graph.link_candidates(rows.where(F.col("collection") == CONVERSATION), rows, as_of=True)
    return found.select("src", "dst", F.round("score", 4).alias("score"), "rank")


def _links(spark, d):
    rows = views.memory(spark, d)
    pairs = graph.link_candidates(rows.where(F.col("collection") == CONVERSATION), rows)
    texts = lambda name, as_: rows.select(F.col("id").alias(name), F.col("text").alias(as_))
    return pairs, judging.lexical_judge(pairs.join(texts("src", "request"), "src").join(texts("dst", "text"), "dst"))


def link_candidates(spark, d):
    return _links(spark, d)[0].select("src", "dst", F.round("score", 6).alias("score"), "rank")


def link_edges(spark, d):
    return graph.link_edges(*_links(spark, d)).select("src", "dst", "kind", F.round("probability", 6).alias("probability"))


def neighborhood(spark, d):
    rows = views.memory(spark, d)
    seeds = index.shortlist(views.requests(spark, d), rows, 5, CONVERSATION)
    found = graph.neighborhood(seeds, views.chain_edges(spark, d), rows, CONVERSATION)
    return found.select("request_id", "id", "depth", F.round("score", 6).alias("score"), "pos")


def _judged(spark, d, requests, candidates, texts=None):
    if texts is None:
        candidates = materialize(candidates)
        texts = recall.passages_of(candidates, views.memory(spark, d).select("id", "text"))
    texts = texts.select("id", "text")
    return judging.lexical_judge(candidates.join(requests, "request_id").join(texts, "id")).select("request_id", "id", "probability")


def lexical_judge(spark, d):
    asked = views.requests(spark, d)
    return _judged(spark, d, asked, index.shortlist(asked, views.memory(spark, d), 5, "default"))


def _recalled(spark, d, keep="true", settings=DEFAULTS, budget=2000):
    asked, rows = views.requests(spark, d), views.memory(spark, d)
    found = materialize(recall.recall_candidates(asked, rows, None, "default"))
    rows = recall.passages_of(found, rows)  # for the judge and for the ranking
    judged = materialize(_judged(spark, d, asked, found, rows)).where(keep)
    return recall.ranked_passages(asked, rows, None, judged, "default", budget, None, settings, found)


def recall_ranked(spark, d):
    ranked, _ = _recalled(spark, d)
    return ranked.select("request_id", "id", "source_id", "probability", "rank", "cost", "used", "fits")


def recall_unranked(spark, d):
    _, unranked = _recalled(spark, d, "probability >= 0.4")
    return unranked.select("request_id", "id", "source_id", "pos", "probability", "unranked")


def recall_section(spark, d):
    ranked, _ = _recalled(spark, d)
    return recall.section(ranked).select("request_id", F.sha2("section", 256).alias("section_sha256"))


def recall_rows(spark, d):
    asked, rows = views.requests(spark, d), views.memory(spark, d)
    found = materialize(recall.recall_candidates(asked, rows, None, "default"))
    rows = recall.passages_of(found, rows)
    out = recall.recall(asked, rows, None, materialize(_judged(spark, d, asked, found, rows)), "default", 2000, candidates=found)
    return out.select("request_id", "status", F.coalesce(F.size("passages"), F.lit(0)).alias("n_passages"), F.array_join("over_budget", ",").alias("over"), "used_tokens", "budget", "estimator")


def recall_request(spark, d):
    said = views.turns(spark, d).select(F.col("conv_id").alias("session_id"), "seq", F.col("text").alias("content"))
    return recall.recall_request(said, 250).select("session_id", F.sha2("request", 256).alias("request_sha256"))


def last_user_text(spark, d):
    return messages.last_user_text(views.session_messages(spark, d)).select("session_id", F.sha2("request", 256).alias("request_sha256"))


def pressure(spark, d):
    sessions = compact.session_tokens(views.session_messages(spark, d))
    return compact.pressure(sessions.withColumn("host_budget", (F.col("session_id") % 3 * 900).cast("int")), TIGHT).select("session_id", "used_tokens", "budget", "under_pressure")


def protected_tail(spark, d):
    return compact.protected_tail(views.session_messages(spark, d), settings=TIGHT)


def _elided(spark, d):
    said = views.session_messages(spark, d)
    return compact.elide(said, views.tool_judgments(said), settings=TIGHT)


def elide(spark, d):
    return _elided(spark, d)[0].select("session_id", "seq", "kind", "status", "elided", F.sha2("content", 256).alias("content_sha256"))


def expand_pages(spark, d):
    return compact.pages(_elided(spark, d)[1], 1000).select("pointer", "page", F.hex("data").alias("data"))


def _asked(spark, d):
    """Payloads, and requests for some of their pages."""
    rows = table(spark, d, "pages")
    payloads = rows.select(tx.pointer_for(F.col("html")).alias("pointer"), F.col("html").cast("binary").alias("original"), F.sha2("html", 256).alias("sha256"))
    asked = rows.select(F.when(F.col("page_id") % 10 == 0, "e:missing").otherwise(tx.pointer_for(F.col("html"))).alias("pointer"), (F.col("page_id") % 4 - 1).alias("page"), "page_id")
    return asked, payloads.dropDuplicates(["pointer"])


def expand(spark, d):
    return compact.expand(*_asked(spark, d), 1000).select("page_id", "found", F.sha2("data", 256).alias("data_sha256"))


def expand_stored(spark, d):
    """From payloads that were stored as pages."""
    (asked, payloads), at = _asked(spark, d), _folder(spark)
    kept_store.write_pages(payloads, at, 1000)
    return kept_store.expand_stored(asked, at).select("page_id", "found", F.sha2("data", 256).alias("data_sha256"))


def frozen_prefix(spark, d):
    return compact.frozen_prefix(views.session_messages(spark, d)).select("session_id", "seq", "id")


def fresh_window(spark, d):
    said, elided = views.session_messages(spark, d), _elided(spark, d)[0]
    pointers = elided.where("elided").select("session_id", "seq", "pointer")
    notes = said.where("kind = 'prose'").select("session_id", F.concat(F.lit("s"), F.col("seq") % 3).alias("source_id"), F.col("content").alias("text"), (F.col("seq") % 4 / 4.0).alias("probability"), F.col("seq").cast("long").alias("nth"))
    pinned = said.where("kind = 'prose' and seq = 1").select("session_id", "seq", "content")
    out = compact.fresh_window(said, pointers, notes, pinned, settings=TIGHT)
    return out.select("session_id", F.sha2(F.array_join("injection", "\n"), 256).alias("injection_sha256"), F.array_join(F.transform("window", lambda x: x["id"]), ",").alias("ids"), "used_tokens", "budget", F.array_join("over_budget", ",").alias("over"))


def prepare_plan(spark, d):
    said, rows, edges = views.session_messages(spark, d), views.memory(spark, d), views.chain_edges(spark, d)
    asked = messages.last_user_text(said).select(F.col("session_id").alias("request_id"), "request")
    built = index.build_index(rows)
    found = {c: materialize(recall.recall_candidates(asked, rows, edges, c, built)) for c in ("default", CONVERSATION)}
    judged = materialize(_judged(spark, d, asked, found["default"].unionByName(found[CONVERSATION])))
    out = compact.prepare(said, rows, edges, views.tool_judgments(said), judged, settings=replace(TIGHT, judge_has_cap=False), candidates=found)
    return out.select("session_id", "status", F.size("context").alias("n_context"), "used_tokens", "budget", F.array_join("over_budget", ",").alias("over"), "under_pressure")


def _log(spark, d):
    said = views.session_messages(spark, d)
    return views.entries(said), views.preparation(said), views.plans(said)


def host_budget(spark, d):
    return host_window.host_budget(_log(spark, d)[1])


def select_fresh_cut(spark, d):
    entries, prepared, _ = _log(spark, d)
    return host_window.select_fresh_cut(entries, host_window.host_budget(prepared).withColumn("summary_tokens", F.lit(50)))


def deepened_cut(spark, d):
    entries, prepared, _ = _log(spark, d)
    return host_window.deepened_cut(prepared, entries, 200)


def plan_compaction(spark, d):
    entries, prepared, plans = _log(spark, d)
    out = host_window.plan_compaction(prepared, entries, plans)
    return out.select("session_id", F.sha2("summary", 256).alias("summary_sha256"), "first_kept_entry_id", "tokens_before", "fresh_cut")


def fit_summary(spark, d):
    plans = _log(spark, d)[2]
    whole = F.array_join("context", "\n\n")
    return plans.select("session_id", F.sha2(host_window.fit_summary(whole, F.lit(120)), 256).alias("summary_sha256"))


def compaction_from_plan(spark, d):
    _, prepared, plans = _log(spark, d)
    plans = plans.withColumns({"estimator": F.lit(DEFAULTS.estimator), "over_budget": F.array().cast("array<string>")})
    return host_window.compaction_from_plan(plans, prepared).select("session_id", F.sha2("summary", 256).alias("summary_sha256"), "first_kept_entry_id", "tokens_before")


def pack_tool_batches(spark, d):
    tools = views.session_messages(spark, d).where("kind = 'tool'")
    return judging.pack_tool_batches(tools, TIGHT)


def _asks(spark, d, request):
    key = F.concat(F.lit("q"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))
    size = judging.question_bytes(key, F.lit("noul").alias("type"), F.col("text").alias("instructions"))
    return table(spark, d, "documents").select(request.alias("request_id"), key.alias("key"), size.alias("entry_bytes"), F.lit(2000).alias("state_bytes"))


def pack_questions(spark, d):
    return judging.pack_questions(_asks(spark, d, F.col("source")), TIGHT)


def pack_one_request(spark, d):
    return judging.pack_questions(_asks(spark, d, F.lit("all")), TIGHT, segment=64)


def _responses(spark, d):
    p = F.col("doc_id") % 10 / 10.0
    kinds = [F.concat(F.lit('{"answers":{"k":{"noul":'), p, F.lit('}},"model":"v1"}')), F.concat(F.lit('{"questions":{"k":{"probability":'), p, F.lit('}},"version":" ","model":"v2"}')), F.lit('{"answers":{"k":{}}}'), F.lit("not json")]
    body = F.when(F.col("doc_id") % 4 == 0, kinds[0]).when(F.col("doc_id") % 4 == 1, kinds[1]).when(F.col("doc_id") % 4 == 2, kinds[2]).otherwise(kinds[3])
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("request_id"), F.lit(0).alias("batch"), body.alias("body"))
    return rows, rows.select("request_id", "batch", F.lit("k").alias("key"), F.lit("noul").alias("type"))


def parse_answers(spark, d):
    return judging.parse_answers(*_responses(spark, d)).select("request_id", "key", "probability", "model_version", "error")


def merge_answers(spark, d):
    rows, asked = _responses(spark, d)
    answers = judging.parse_answers(rows, asked)
    again = answers.where("request_id % 8 = 0").withColumn("batch", F.lit(1))
    more = asked.select("request_id", "batch", F.explode(F.when(F.col("request_id") % 12 == 1, F.array(F.lit("k"), F.lit("z"))).otherwise(F.array(F.lit("k")))).alias("key"))
    return judging.merge_answers(answers.unionByName(again), more)


def validate_questions(spark, d):
    docs = table(spark, d, "documents")
    kind = F.when(F.col("doc_id") % 5 == 0, "guess").when(F.col("doc_id") % 5 == 1, "choice").otherwise("noul")
    return judging.validate_questions(docs.select("doc_id", kind.alias("type"), F.when(F.col("doc_id") % 7 == 0, "  \t").otherwise(F.col("text")).alias("instructions"))).select("doc_id", "type", "error")


def _payload(spark, d):
    said = views.turns(spark, d).select(F.col("conv_id").alias("session_id"), "seq", "role", "text")
    item = F.struct(F.col("role"), F.col("text").alias("content"), F.concat(F.lit("m"), "seq").alias("id"))
    listed = F.array_sort(F.collect_list(F.struct("seq", item.alias("m"))))
    return said.groupBy("session_id").agg(F.to_json(F.struct(F.transform(listed, lambda x: x["m"]).alias("messages"))).alias("payload"))


def normalize_messages(spark, d):
    return messages.normalize_messages(_payload(spark, d)).select("session_id", "seq", "part", "id", "role", "kind", F.sha2("content", 256).alias("content_sha256"))


def candidate_turns(spark, d):
    said = views.turns(spark, d)
    block = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.concat(F.lit(" "), "text").alias("text"))))
    return messages.candidate_turns(said.select("arrival", "role", block.alias("content_json"))).select("arrival", "role", F.sha2("content", 256).alias("content_sha256"))


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"


def read_turns(spark, d):
    said = views.turns(spark, d)
    item = F.struct("role", F.col("text").alias("content"), F.lit(False).alias("generated_summary"))
    listed = F.array_sort(F.collect_list(F.struct("seq", item.alias("m"))))
    rows = said.groupBy("session_id").agg(F.transform(listed, lambda x: x["m"]).alias("messages"))
    at = _folder(spark)
    rows.select(F.lit("/w").alias("cwd"), "session_id", F.concat(F.lit("src-"), "session_id").alias("source_id"), "messages").write.json(at)
    return tables.read_turns(spark, at).select("cwd", "session_id", "source_id", "place", "role", F.sha2("text", 256).alias("text_sha256"), "generated_summary")


def stored_memory(spark, d):
    at = _folder(spark)
    tables.write_memory(views.memory(spark, d), at)
    return tables.read_memory(spark, at, CONVERSATION).select("id", "collection", "source_id", "sha256", F.sha2("text", 256).alias("text_sha256"), "session_id", "role")


def stored_edges(spark, d):
    at = _folder(spark)
    tables.write_edges(views.chain_edges(spark, d), at)
    return tables.read_edges(spark, at)


def stored_elisions(spark, d):
    at = _folder(spark)
    rows = table(spark, d, "pages").select(tx.pointer_for(F.col("html")).alias("pointer"), F.col("html").cast("binary").alias("original"), F.sha2("html", 256).alias("sha256"))
    tables.write_elisions(store.upsert_elisions(rows.limit(0), rows), at)
    return tables.read_elisions(spark, at).select("pointer", F.octet_length("original").alias("n_bytes"), F.sha2("original", 256).alias("original_sha256"))


def read_judgments(spark, d):
    at = _folder(spark)
    _responses(spark, d)[0].select(F.col("request_id").cast("string"), "batch", "body").write.json(at)
    return tables.read_judgments(spark, at)


def write_plans(spark, d):
    at = _folder(spark)
    over = F.when(F.col("session_id") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    tables.write_plans(views.plans(views.session_messages(spark, d)).withColumn("over_budget", over), at)
    lines = spark.read.text(at).withColumn("value", F.parse_json("value"))
    get = lambda path, kind: F.variant_get("value", f"$.{path}", kind)
    return lines.select(
        get("session_id", "long").alias("session_id"), get("status", "string").alias("status"), F.sha2(F.array_join(get("context", "array<string>"), "|"), 256).alias("context_sha256"),
        F.array_join(get("over_budget", "array<string>"), ",").alias("over"),
    )


def read_text_sources(spark, d):
    at = _folder(spark)
    listed = F.array_sort(F.collect_list(F.struct("seq", "text")))
    views.turns(spark, d).groupBy(F.col("session_id").alias("source_id")).agg(F.transform(listed, lambda x: x["text"]).alias("texts")).write.json(at)
    return tables.read_text_sources(spark, at, "notes").select("collection", "source_id", "place", "sha256")


def _typed_entries(spark, d):
    """Turns as log entries of five types."""
    said = views.turns(spark, d).select(F.col("conv_id").alias("session_id"), "seq", "role", "text")
    kind = F.element_at(F.array(*map(F.lit, ("message", "compaction", "branch_summary", "custom_message", "model_change"))), F.col("seq") % 5 + 1)
    return said.select(
        "session_id", "seq", F.concat(F.lit("e"), "seq").alias("id"), kind.alias("type"), F.to_json(F.struct("role", F.col("text").alias("content"))).alias("message_json"),
        F.col("text").alias("summary"), F.when(F.col("seq") % 2 == 0, F.to_json(F.struct(F.col("text").alias("t")))).alias("content_json"),
    )


def entry_tokens(spark, d):
    rows = _typed_entries(spark, d)
    return rows.select("session_id", "seq", "type", tx.entry_tokens(rows).alias("tokens"))


def _nested(text, depth):
    """JSON of blocks around a text, so many levels deep, with a block beside each."""
    json = F.to_json(F.struct(text.alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(text.alias("t")))) - 6)
    for level in range(depth):
        json = F.concat(F.lit('[{"type":"text","content":'), json, F.lit(f'}},{{"type":"image"}},{{"text":"level {level}"}}]'))
    return json


def text_of(spark, d):
    rows = table(spark, d, "documents").where("text is not null")
    text, way = F.col("text"), F.col("doc_id") % 6
    deep = [F.when(way == n, _nested(text, n)) for n in (0, 1, 2, 5)]
    json = F.coalesce(*deep, F.when(way == 3, F.to_json(F.struct(text.alias("text")))), F.lit("[1, null]"))
    return rows.select("doc_id", F.sha2(tx.text_of(json), 256).alias("text_sha256"))


def session_turns(spark, d):
    rows = _typed_entries(spark, d).withColumn("type", F.when(F.col("seq") % 3 < 2, "message").otherwise(F.col("type")))
    return messages.session_turns(rows).select("session_id", "seq", "role", F.sha2("content", 256).alias("content_sha256"))


def _prepared_messages(spark, d):
    rows = _typed_entries(spark, d)
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("seq", "message_json")))), lambda x: x["message_json"])
    return rows.groupBy("session_id").agg(listed(F.col("seq") < 2).alias("to_summarize"), listed((F.col("seq") >= 2) & (F.col("seq") < 4)).alias("turn_prefix"))


def messages_from_preparation(spark, d):
    return messages.messages_from_preparation(_prepared_messages(spark, d)).select("session_id", "seq", "id", "role", "kind", F.sha2("content", 256).alias("content_sha256"))


def _events(spark, d):
    events = _prepared_messages(spark, d).withColumns({"first_kept_entry_id": F.lit("e4"), "tokens_before": F.lit(1000), "reserve_tokens": F.lit(100), "keep_recent_tokens": F.lit(300)})
    return events.withColumns({"context_window": F.lit(400), "session_id": F.col("session_id")})


def messages_for_compaction(spark, d):
    events, entries = _events(spark, d), _typed_entries(spark, d).withColumn("type", F.lit("message"))
    cuts = events.select("session_id", F.when(F.col("session_id") % 3 == 0, DEFAULTS.window_id).when(F.col("session_id") % 3 == 1, "e6").otherwise("e4").alias("cut"))
    out = host_window.messages_for_compaction(events, entries, cuts)
    return out.select("session_id", "part", "seq", "role", "kind", F.sha2("content", 256).alias("content_sha256"))


def _pairs(spark, d, asked):
    """The shortlist with both texts."""
    found = materialize(index.shortlist(asked, views.memory(spark, d), 5, "default"))
    return found.join(asked, "request_id").join(recall.passages_of(found, views.memory(spark, d).select("id", "text")), "id")


def judge(spark, d):
    asked = views.requests(spark, d)
    pairs = _pairs(spark, d, asked)
    return judging.judge(pairs, lambda request, text: (request.str.len() * 3 + text.str.len()) % 100 / 100.0).select("request_id", "id", "probability")


def judge_kept(spark, d):
    """The same pairs in two overlapping lots: what the first has judged, the second reads."""
    asked, at = views.requests(spark, d), _folder(spark)
    pairs = materialize(_pairs(spark, d, asked))
    score = lambda request, text: (request.str.len() * 3 + text.str.len()) % 100 / 100.0
    judging.judge(pairs.where("rank < 4"), score, kept=at, model_version="v1")
    return judging.judge(pairs, score, kept=at, model_version="v1").select("request_id", "id", "probability")


def _captured(spark, d):
    """A store that took in two overlapping parts of the turns, the second twice."""
    said, at = views.turns(spark, d), _folder(spark)
    edges = f"{at}_edges"
    for part in ("conv_id % 3 < 2", "conv_id % 3 > 0", "conv_id % 3 > 0"):
        streams.capture_batch(said.where(part).drop("conv_id", "seq"), at, edges, judging.lexical_judge)
    return at


def capture_batches(spark, d):
    at = _captured(spark, d)
    return tables.read_memory(spark, at).select("id", "collection", "source_id", "sha256", "session_id", "role")


def recall_batches(spark, d):
    at, edges, asked = _folder(spark), _folder(spark), views.requests(spark, d)
    tables.write_memory(views.memory(spark, d), at)
    tables.write_edges(views.chain_edges(spark, d), edges)
    for n in range(2):
        streams.recall_batch(asked.where(F.col("request_id") % 2 == n), at, edges, f"{at}_out/batch={n}")
    return spark.read.schema("request_id long, section string, batch int").parquet(f"{at}_out").select("request_id", "batch", F.sha2("section", 256).alias("section_sha256"))


NAMES = [
    token_estimates, content_pointers, label_passages, session_tokens, classify_turns, ingest_new, capture_summary, replace_source, gated_remember,
    count_memory, memory_rows, upsert_edges, upsert_elisions, cascade_delete, index_tokens, build_index, shortlist_bm25, link_candidates, link_edges,
    neighborhood, lexical_judge, recall_ranked, recall_unranked, recall_section, recall_rows, recall_request, last_user_text, pressure, protected_tail,
    elide, expand_pages, expand, frozen_prefix, fresh_window, prepare_plan, host_budget, select_fresh_cut, deepened_cut, plan_compaction, fit_summary,
    compaction_from_plan, pack_tool_batches, pack_questions, pack_one_request, parse_answers, merge_answers, validate_questions, normalize_messages, candidate_turns,
    read_turns, stored_memory, stored_edges, stored_elisions, read_judgments, write_plans, read_text_sources, entry_tokens, text_of, session_turns,
    messages_from_preparation, messages_for_compaction, judge, judge_kept, kept_shortlist, links_of_the_moment, ingest_kept, replace_stored, expand_stored, capture_batches, recall_batches,
]
QUERIES = {f.__name__: f for f in NAMES}
