"""The registered queries in SQL for DuckDB, from common table expressions."""

from __future__ import annotations

import re

from ..config import DEFAULTS
from ..functions.text import ACCENTED, FOLDED, PLAIN, SPECIAL
from .views import TIGHT

CTES = {
    "turns": "SELECT conv_id * 1000 + turn AS arrival, text, role, CAST(conv_id AS VARCHAR) AS session_id, conv_id, turn AS seq FROM conversations",
    "again": "SELECT * FROM turns UNION ALL SELECT arrival + 1000000000, text, role, session_id, conv_id, seq FROM turns WHERE arrival % 3 = 0",
    "memory": """SELECT doc_id AS id, 'default' AS collection, source AS source_id, text, '' AS session_id, '' AS role FROM documents
        UNION ALL SELECT arrival + 1000000000, 'conversation', session_id, text, session_id, role FROM turns WHERE role IN ('user', 'assistant')""",
    "requests": "SELECT item_id AS request_id, text AS request FROM benchmark",
    "edges": """SELECT arrival + 1000000000 AS src, arrival + 1000000000 - back AS dst, 'related' AS kind, (conv_id * 31 + seq * 17 + back * 7) % 100 / 100.0::DOUBLE AS probability
        FROM turns, (VALUES (1), (2)) b(back) WHERE role IN ('user', 'assistant') AND seq > 0 AND seq >= back""",
    "said": """SELECT conv_id AS session_id, seq, 'm' || seq AS id, role, CASE WHEN role = 'system' THEN 'prefix' ELSE 'prose' END AS kind, text AS content FROM turns
        UNION ALL SELECT page_id % (SELECT max(conv_id) + 1 FROM conversations), 1000 + page_id, 'call-' || page_id, 'tool', 'tool', html FROM pages""",
    "sized": "SELECT *, (octet_length(encode(content)) + 3) // 4 AS cost FROM said",
    "fresh": """SELECT * FROM (SELECT *, sha256(text) AS hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY arrival) AS nth FROM again
        WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE nth = 1 AND hash NOT IN (SELECT sha256(text) FROM documents WHERE text IS NOT NULL)""",
}


def _tokens(column: str) -> str:
    return f"regexp_extract_all(translate(lower(translate({column}, '{SPECIAL}', '{FOLDED}')), '{ACCENTED}', '{PLAIN}'), '[\\p{{L}}\\p{{Nd}}]+')"


CTES["terms"] = f"SELECT id, collection, {_tokens('text')} AS tokens FROM memory"
CTES["postings"] = "SELECT id, collection, token, count(*) AS tf FROM (SELECT id, collection, unnest(tokens) AS token FROM terms) GROUP BY ALL"
CTES["lengths"] = "SELECT id, len(tokens) AS n FROM terms"
CTES["stats"] = "SELECT count(*) AS n_docs, avg(n) AS avg_len FROM lengths"
CTES["dfs"] = "SELECT token, count(*) AS df FROM postings GROUP BY token"


def _shortlist(name: str, asked: str, collection: str, limit: int, older: bool = False) -> dict[str, str]:
    """CTEs for the best rows of each request of the CTE ``asked``; the last is called ``name``."""
    return {
        f"{name}_q": f"""SELECT request_id, token, count(*) AS mult FROM (SELECT request_id, unnest(list_slice(t, greatest(len(t) - {DEFAULTS.max_query_tokens - 1}, 1), len(t))) AS token
            FROM (SELECT request_id, {_tokens('request')} AS t FROM {asked})) GROUP BY ALL""",
        f"{name}_s": f"""SELECT request_id, id, round(sum(mult * greatest(CASE WHEN n_docs - df + 0.5 <= df + 0.5 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END, 0)
              * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / avg_len))), 9) AS score
            FROM {name}_q JOIN postings USING (token) JOIN dfs USING (token) JOIN lengths USING (id), stats
            WHERE collection = '{collection}' {"AND id < request_id" if older else ""} GROUP BY ALL""",
        name: f"SELECT request_id, id, score, CAST(row_number() OVER w AS INTEGER) AS rank FROM {name}_s WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= {limit}",
    }


def _near(name: str, seeds: str) -> dict[str, str]:
    return {
        f"{name}_b": "SELECT src, dst, max(probability) AS p FROM (SELECT src, dst, probability FROM edges UNION ALL SELECT dst, src, probability FROM edges) WHERE dst IN (SELECT id FROM memory WHERE collection = 'conversation') GROUP BY ALL",
        f"{name}_1": f"SELECT request_id, dst AS id, max(p) AS score FROM {seeds} JOIN {name}_b ON src = id GROUP BY ALL",
        f"{name}_2": f"SELECT request_id, dst AS id, max(p) AS score FROM {name}_1 JOIN {name}_b ON src = id GROUP BY ALL",
        f"{name}_n": f"""SELECT request_id, id, min(depth) AS depth, max(score) AS score FROM (SELECT request_id, id, 1.0::DOUBLE AS score, 0 AS depth FROM {seeds}
            UNION ALL SELECT *, 1 FROM {name}_1 UNION ALL SELECT *, 2 FROM {name}_2) GROUP BY ALL""",
        name: f"""SELECT *, CAST(row_number() OVER w AS INTEGER) AS pos FROM {name}_n
            WINDOW w AS (PARTITION BY request_id ORDER BY depth, CASE WHEN depth = 0 THEN 0 ELSE -score END, id) QUALIFY row_number() OVER w <= {DEFAULTS.shortlist_limit}""",
    }


def _judge(name: str, pairs: str, asked: str) -> dict[str, str]:
    """Pairs (request_id, id) with the lexical judge's probability."""
    last = f"list_slice(t, greatest(len(t) - {DEFAULTS.max_query_tokens - 1}, 1), len(t))"
    return {
        f"{name}_t": f"SELECT request_id, list_distinct({last}) AS asked FROM (SELECT request_id, {_tokens('request')} AS t FROM {asked})",
        name: f"SELECT p.*, round(len(list_intersect(asked, tokens)) / nullif(len(asked), 0)::DOUBLE, 9) AS probability FROM {pairs} p JOIN {name}_t USING (request_id) JOIN terms USING (id)",
    }


def _ranked(name: str, judged: str, budget: int) -> dict[str, str]:
    """From (request_id, id, pos, probability) of whole requests: rank, cost, used and fits."""
    return {
        f"{name}_r": f"SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY probability DESC, pos) AS INTEGER) AS rank FROM {judged} WHERE probability >= {DEFAULTS.recall_cutoff}",
        f"{name}_l": f"""SELECT r.*, source_id, CASE WHEN collection = 'conversation' THEN '[session:' || session_id || ' cwd:]' || chr(10) || text ELSE text END AS label
            FROM {name}_r r JOIN memory USING (id)""",
        f"{name}_c": f"SELECT *, (octet_length(encode(label)) + 3) // 4 AS cost FROM {name}_l",
        name: f"SELECT *, CAST(sum(cost) OVER w AS BIGINT) AS used, sum(cost) OVER w <= {budget} AS fits FROM {name}_c WINDOW w AS (PARTITION BY request_id ORDER BY rank ROWS UNBOUNDED PRECEDING)",
    }


def _sql(select: str, more: dict[str, str] | None = None) -> str:
    """A query with those of the common expressions that it needs, in order."""
    known = CTES | (more or {})
    order, todo, needed = list(known), [select], set()
    while todo:
        part = todo.pop()
        for name in re.findall(r"[a-z_0-9]+", part):
            if name in known and name not in needed:
                needed.add(name)
                todo.append(known[name])
    ctes = ", ".join(f"{n} AS ({known[n]})" for n in sorted(needed, key=order.index))
    return f"WITH {'RECURSIVE ' if any(n.endswith('filled') for n in needed) else ''}{ctes} {select}" if ctes else select


def _json_bytes(value: str) -> str:
    """Bytes of a value's JSON once <, > and & are written as six-byte escapes."""
    json = f"CAST(to_json({value}) AS VARCHAR)"
    return f"(octet_length(encode({json})) + 5 * (length({json}) - length(translate({json}, '<>&', ''))))"


def _fills(name: str, rows: str, room: str, key: str, order: str) -> dict[str, str]:
    """CTE ``name``_filled: rows (key, order, cost and others) with a batch, filled in order while the sum stays within the room."""
    return {
        f"{name}_nth": f"SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS nth FROM {rows}",
        f"{name}_filled": f"""SELECT *, 1 AS batch, cost::BIGINT AS total FROM {name}_nth WHERE nth = 1 UNION ALL
        SELECT t.*, CASE WHEN f.total + t.cost > {room} THEN f.batch + 1 ELSE f.batch END, (CASE WHEN f.total + t.cost > {room} THEN t.cost ELSE f.total + t.cost END)::BIGINT
        FROM {name}_filled f JOIN {name}_nth t ON t.{key} = f.{key} AND t.nth = f.nth + 1""",
    }


#: What a batch of tool outputs may hold, and the estimate of its joined text: "[id]\\ncontent", parted by a blank line.
_CAP = max(TIGHT.token_limit - TIGHT.batch_slack, TIGHT.batch_floor)
_JOINED = f"(sum(octet_length(encode('[' || id || ']' || chr(10) || content))) OVER b + 2 * (count(*) OVER b - 1) + 3) // 4 <= {_CAP}"


_SHORT = _shortlist("short", "requests", "default", DEFAULTS.shortlist_limit)
_FIVE = _shortlist("five", "requests", "default", 5)
_POS = {"cand": "SELECT request_id, id, rank AS pos FROM short"}
#: Requests whose passages fit into one call to the judge.
_FITTING = {
    "shown": f"""SELECT request_id, {_json_bytes("{'id': 'rel_' || (pos - 1), 'text': coalesce(text, '')}")} AS size,
        {_json_bytes("'rel_' || (pos - 1)")} + 1 + {_json_bytes("{'type': 'noul', 'instructions': '" + DEFAULTS.recall_instructions + "'}")} AS question FROM cand JOIN memory USING (id)""",
    "fitting": f"""SELECT request_id FROM (SELECT request_id, sum(size) + count(*) - 1 AS passages, max(question) AS question FROM shown GROUP BY request_id) JOIN requests USING (request_id)
        WHERE {len('{"questions":{},"state":}') + len('{"passages":[],"request":}')} + passages + {_json_bytes("request")} + question <= {DEFAULTS.token_limit * 4}""",
    "fair": "SELECT * FROM judged WHERE request_id IN (SELECT request_id FROM fitting)",
}
_RECALL = _SHORT | _POS | _judge("judged", "cand", "requests") | _FITTING | _ranked("ranked", "fair", 2000)
_LINK = {"newer": "SELECT id AS request_id, text AS request FROM memory WHERE collection = 'conversation'"} | _shortlist("linked", "newer", "conversation", DEFAULTS.link_seeds, True) | _judge("link_p", "linked", "newer")
_TIGHT_TAIL = TIGHT.protected_tail_tokens
_ELIDE = {
    "tail": f"""SELECT session_id, seq, cost, sum(cost) OVER w <= {_TIGHT_TAIL} AND sum(cost) OVER w - cost < {_TIGHT_TAIL} AS protected FROM sized WHERE kind = 'tool'
        WINDOW w AS (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING)""",
    "pressed": f"SELECT session_id, CAST(sum(cost) AS BIGINT) AS used_tokens, sum(cost) >= {TIGHT.token_budget} * {TIGHT.pressure_ratio} AS under_pressure FROM sized GROUP BY session_id",
    "marks": "SELECT session_id, seq, CASE WHEN (seq - 1000) % 40 <> 7 THEN (seq - 1000) * 37 % 100 / 100.0 END AS p FROM said WHERE kind = 'tool'",
    "open": f"""SELECT session_id, seq, s.id, content, p, s.cost + {TIGHT.item_overhead} AS cost FROM tail JOIN marks USING (session_id, seq) JOIN sized s USING (session_id, seq)
        WHERE NOT protected AND session_id IN (SELECT session_id FROM pressed WHERE under_pressure)""",
    **_fills("open", "open", str(_CAP), "session_id", "seq"),
    "eligible": f"SELECT session_id, seq, CASE WHEN {_JOINED} THEN p END AS p FROM open_filled WINDOW b AS (PARTITION BY session_id, batch)",
    "fallen": "SELECT DISTINCT session_id FROM eligible WHERE p IS NULL",
    "low": f"SELECT session_id, seq FROM eligible WHERE p < {TIGHT.drop_threshold} AND session_id NOT IN (SELECT session_id FROM fallen)",
    "elided": f"""SELECT s.*, l.seq IS NOT NULL AS elided, CASE WHEN f.session_id IS NULL THEN 'compacted' ELSE 'fallback' END AS status,
        CASE WHEN l.seq IS NULL THEN content ELSE replace('{DEFAULTS.pointer_format}', '%s', 'e:' || sha256(content)) END AS body, 'e:' || sha256(content) AS pointer
        FROM said s LEFT JOIN low l USING (session_id, seq) LEFT JOIN fallen f USING (session_id)""",
}
_PREFIX = {
    "prefix": "SELECT session_id, seq, id, content FROM (SELECT *, sum(CASE WHEN kind <> 'prefix' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS other FROM said) WHERE other = 0"
}


def _window(sessions: str, fixed: str, notes: str) -> dict[str, str]:
    """A fresh window: fixed (session_id, part, nth, id, content) and notes (session_id, source_id, text, probability, nth)."""
    return {
        "fixed": fixed,
        "notes": notes,
        "base": "SELECT session_id, sum((octet_length(encode(content)) + 3) // 4) AS base FROM fixed GROUP BY session_id",
        "placed": f"""SELECT n.*, row_number() OVER w AS place, coalesce(base, 0) + sum((octet_length(encode(text)) + 3) // 4) OVER (w ROWS UNBOUNDED PRECEDING) <= {TIGHT.token_budget} AS fits
            FROM notes n LEFT JOIN base USING (session_id) WINDOW w AS (PARTITION BY session_id ORDER BY probability DESC, source_id, nth)""",
        "items": "SELECT * FROM fixed UNION ALL SELECT session_id, 3, place, 'mem-' || source_id, '[source:' || source_id || ']' || chr(10) || text FROM placed WHERE fits",
        "overs": "SELECT session_id, string_agg(source_id, ',' ORDER BY place) AS over FROM placed WHERE NOT fits GROUP BY session_id",
        "made": f"""SELECT session_id, string_agg(id, ',' ORDER BY part, nth) AS ids, string_agg(content, chr(10) ORDER BY part, nth) FILTER (WHERE part >= 2) AS injection,
            count(*) FILTER (WHERE part >= 2) AS n_context, CAST(sum((octet_length(encode(content)) + 3) // 4) AS BIGINT) AS used FROM items GROUP BY session_id""",
        "windows": f"""SELECT session_id, ids, coalesce(injection, '') AS injection, coalesce(n_context, 0) AS n_context, coalesce(used, 0) AS used_tokens, {TIGHT.token_budget}::BIGINT AS budget, coalesce(over, '') AS over
            FROM (SELECT DISTINCT session_id FROM {sessions}) LEFT JOIN made USING (session_id) LEFT JOIN overs USING (session_id)""",
    }


_LINES = f"SELECT session_id, 2, seq, pointer, replace('{DEFAULTS.pointer_format}', '%s', pointer) FROM elided WHERE elided"
_FRESH = _ELIDE | _PREFIX | _window(
    "said",
    f"SELECT session_id, 0 AS part, seq AS nth, id, content FROM prefix UNION ALL SELECT session_id, 1, 0, 'pin-0', content FROM said WHERE kind = 'prose' AND seq = 1 UNION ALL {_LINES}",
    "SELECT session_id, 's' || (seq % 3) AS source_id, content AS text, seq % 4 / 4.0::DOUBLE AS probability, seq AS nth FROM said WHERE kind = 'prose'",
)
_LAST = {
    "asked": """SELECT session_id, coalesce(arg_max(content, seq) FILTER (WHERE role = 'user' AND kind = 'prose' AND trim(content) <> ''), '') AS request FROM said GROUP BY session_id""",
    "wants": "SELECT session_id AS request_id, request FROM asked",
}
_PREPARE = (
    _ELIDE
    | {"eligible": "SELECT session_id, seq, p FROM open"}  # a judge without a cap
    | _PREFIX
    | _LAST
    | _shortlist("short_d", "wants", "default", 20)
    | _shortlist("short_c", "wants", "conversation", 20)
    | _near("near_c", "short_c")
    | {"pos_d": "SELECT request_id, id, rank AS pos FROM short_d", "pos_c": "SELECT request_id, id, pos FROM near_c"}
    | _judge("judged_d", "pos_d", "wants")
    | _judge("judged_c", "pos_c", "wants")
    | _ranked("ranked_d", "judged_d", TIGHT.token_budget)
    | _ranked("ranked_c", "judged_c", TIGHT.inject_budget)
    | {"good": "SELECT * FROM said WHERE session_id NOT IN (SELECT session_id FROM fallen)"}
    | _window(
        "good",
        f"SELECT session_id, 0 AS part, seq AS nth, id, content FROM prefix WHERE session_id NOT IN (SELECT session_id FROM fallen) UNION ALL {_LINES}",
        """SELECT * FROM (SELECT request_id AS session_id, source_id, label AS text, probability, rank AS nth FROM ranked_d WHERE fits
           UNION ALL SELECT request_id, source_id, label, probability, 1000000 + rank FROM ranked_c WHERE fits) WHERE session_id NOT IN (SELECT session_id FROM fallen)""",
    )
)
_LOG = {
    "entries": "SELECT session_id, seq, 'e' || seq AS id, content, (length(content) + 3) // 4 AS cost FROM said",
    "prep": """SELECT session_id, CASE WHEN session_id % 11 <> 5 THEN 'e' || low END AS first_id, low, tokens_before, CASE WHEN session_id % 7 * 500 > 100 THEN session_id % 7 * 500 - 100 ELSE 300 END AS budget
        FROM (SELECT session_id, min(seq) AS low, CAST(sum(length(content)) AS BIGINT) AS tokens_before FROM said GROUP BY session_id)""",
    "suffix": "SELECT e.*, budget FROM entries e JOIN prep USING (session_id) WHERE first_id IS NOT NULL",
    "plans": "SELECT session_id, list(content ORDER BY seq) AS context, CASE WHEN session_id % 4 = 3 THEN 'fallback' ELSE 'compacted' END AS status FROM said WHERE seq < 3 GROUP BY session_id",
}


def _cut(name: str, rows: str, summary: str) -> dict[str, str]:
    """The longest suffix of ``rows`` (session_id, seq, id, cost, budget) that fits with the summary's tokens."""
    return {
        f"{name}_f": f"""SELECT session_id, seq, id, run FROM (SELECT *, sum(cost) OVER (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS run, {summary} AS summary FROM {rows})
            WHERE budget > 0 AND summary <= budget AND summary + run <= budget""",
        name: f"SELECT session_id, arg_min(id, seq) AS first_kept, CAST(max(run) AS BIGINT) AS kept_tokens FROM {name}_f GROUP BY session_id",
    }


def _fit(text: str, budget: str) -> str:
    """Leading parts of a list of lines that fit: a running cost, parted by one token each."""
    return f"""CASE WHEN {text} = '' THEN '' WHEN (length({text}) + 3) // 4 <= {budget} THEN {text} ELSE array_to_string(list_slice(string_split({text}, chr(10) || chr(10)), 1,
        len(list_filter(range(1, len(string_split({text}, chr(10) || chr(10))) + 1), lambda i: list_sum(list_transform(list_slice(string_split({text}, chr(10) || chr(10)), 1, i), lambda x: (length(x) + 3) // 4)) + i - 1 <= {budget}))), chr(10) || chr(10)) END"""


_LINE = DEFAULTS.window_line
_LINE_COST = -(-len(_LINE) // 4)
_COMPACT = (
    _LOG
    | {
        "sums": "SELECT session_id, sum(cost) AS suffix_tokens FROM suffix GROUP BY session_id",
        "texts": """SELECT p.*, coalesce(suffix_tokens, 0) AS suffix_tokens, coalesce(CASE WHEN status = 'compacted' THEN array_to_string(context, chr(10) || chr(10)) END, '') AS whole
            FROM prep p LEFT JOIN plans USING (session_id) LEFT JOIN sums USING (session_id)""",
        "fitted": f"SELECT *, {_fit('whole', 'budget')} AS summary FROM texts",
        "overs": f"SELECT *, (length(summary) + 3) // 4 + suffix_tokens > budget AS over, CASE WHEN summary = '' THEN {_LINE_COST} ELSE (length(summary) + 3) // 4 END AS size FROM fitted",
        "rows_in": "SELECT s.*, size FROM suffix s JOIN overs USING (session_id)",
    }
    | _cut("later", "rows_in", "size")
    | {
        "chosen": f"""SELECT o.session_id, budget, tokens_before, first_id, CASE WHEN over THEN coalesce(first_kept, '{DEFAULTS.window_id}') ELSE first_id END AS kept_id,
            CASE WHEN over AND summary = '' THEN '{_LINE}' ELSE summary END AS summary, CASE WHEN NOT over THEN suffix_tokens WHEN first_kept IS NULL THEN 0 ELSE kept_tokens END AS tail
            FROM overs o LEFT JOIN later USING (session_id)""",
        "final": f"""SELECT session_id, CASE WHEN (length(summary) + 3) // 4 + tail > budget THEN coalesce(nullif({_fit('summary', 'greatest(budget - tail, 0)')}, ''), '{_LINE}') ELSE summary END AS text,
            kept_id, tokens_before, kept_id IS DISTINCT FROM first_id AS fresh_cut FROM chosen WHERE summary <> '' AND kept_id <> ''""",
    }
)
_PACK = {"tools": f"SELECT session_id, seq, id, content, cost + {TIGHT.item_overhead} AS cost FROM sized WHERE kind = 'tool'"} | _fills("tools", "tools", str(_CAP), "session_id", "seq")
_ROOM = TIGHT.token_limit * 4 - len('{"questions":{},"state":}') - 2000
_ASK = {
    "keyed": "SELECT source AS request_id, 'q' || lpad(doc_id::VARCHAR, 9, '0') AS key, text FROM documents",
    "entered": f"""SELECT request_id, key, {_json_bytes("key")} + 1 + CASE WHEN text IS NULL THEN {len('{"type":"noul"}')} ELSE {_json_bytes("{'type': 'noul', 'instructions': text}")} END AS entry FROM keyed""",
    "asks": f"SELECT request_id, key, entry + 1 AS cost FROM entered WHERE entry <= {_ROOM}",
    "failing": f"SELECT DISTINCT request_id FROM entered WHERE entry > {_ROOM}",
} | _fills("asks", "asks", str(_ROOM + 1), "request_id", "key")
_ASKED = f"""SELECT request_id, key, batch::BIGINT AS batch, CASE WHEN request_id IN (SELECT request_id FROM failing) THEN 'budget' END AS error FROM asks_filled
            UNION ALL SELECT request_id, key, NULL, 'budget' FROM entered WHERE entry > {_ROOM}"""
_P = "CASE WHEN doc_id % 4 IN (0, 1) THEN doc_id % 10 / 10.0::DOUBLE END"
_V = "CASE doc_id % 4 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' END"

ORACLES: dict[str, str] = {
    "token_estimates": "SELECT doc_id, CAST((octet_length(encode(text)) + 3) // 4 AS BIGINT) AS tokens, CAST((length(text) + 3) // 4 AS BIGINT) AS tokens_utf16 FROM documents",
    "content_pointers": f"SELECT page_id, sha256(html) AS sha256, 'e:' || sha256(html) AS pointer, replace('{DEFAULTS.pointer_format}', '%s', 'e:' || sha256(html)) AS line FROM pages",
    "label_passages": _sql("SELECT id, sha256(CASE WHEN collection = 'conversation' THEN '[session:' || session_id || ' cwd:]' || chr(10) || text ELSE text END) AS label_sha256 FROM memory"),
    "session_tokens": _sql("SELECT session_id, CAST(sum(cost) AS BIGINT) AS used_tokens FROM sized GROUP BY session_id"),
    "classify_turns": _sql(
        f"""SELECT arrival, role, session_id AS source_id, CASE WHEN starts_with(trim(text), '{DEFAULTS.summary_marker}') THEN 'refused' WHEN role IN ('user', 'assistant') AND trim(text) <> '' THEN 'candidate' ELSE 'ignored' END AS status,
            CASE WHEN starts_with(trim(text), '{DEFAULTS.summary_marker}') THEN 'summary' END AS reason FROM turns"""
    ),
    "ingest_new": _sql("SELECT CAST(row_number() OVER (ORDER BY arrival) AS BIGINT) AS id, arrival, session_id AS source_id, hash AS sha256, session_id, role FROM fresh"),
    "ingest_kept": _sql(
        """SELECT arrival, session_id AS source_id, hash AS sha256, session_id, role FROM fresh
           WHERE hash NOT IN (SELECT sha256(text) FROM turns WHERE role IN ('user', 'assistant') AND conv_id % 6 = 3 AND text IS NOT NULL)"""
    ),
    "capture_summary": _sql("SELECT a.session_id, count(f.arrival) AS stored, count(*) - count(f.arrival) AS ignored FROM again a LEFT JOIN fresh f USING (arrival) GROUP BY a.session_id"),
    "replace_source": _sql(
        """SELECT id, collection, source_id, sha256(text) AS sha256 FROM memory WHERE NOT (collection = 'default' AND (source_id = 'src3' OR source_id IN
            ('src1', 'src2')))
           UNION ALL SELECT id + 10000000000, collection, source_id, sha256(text) FROM memory WHERE source_id IN ('src1', 'src2')"""
    ),
    "gated_remember": """SELECT d.doc_id AS subject_id, CASE WHEN d.doc_id % 17 = 0 THEN 'refused' WHEN l.doc_id IS NULL THEN 'unavailable' WHEN quality = 1 THEN 'stored' ELSE 'refused' END AS status,
        CASE WHEN d.doc_id % 17 = 0 THEN 'summary' WHEN l.doc_id IS NOT NULL AND quality IS DISTINCT FROM 1 THEN 'below_threshold' END AS reason,
        CASE WHEN l.doc_id IS NULL THEN NULL WHEN quality = 1 THEN 0.9 ELSE 0.2 END::DOUBLE AS probability, CASE WHEN l.doc_id IS NOT NULL THEN 'v1' END AS model_version
        FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "count_memory": _sql("SELECT collection, source_id, count(*) AS n FROM memory GROUP BY ALL"),
    "memory_rows": _sql("SELECT id, source_id, sha256(text) AS sha256, '' AS cwd, session_id, role FROM memory WHERE collection = 'conversation'"),
    "upsert_edges": _sql("SELECT src, dst, kind, round(CASE WHEN probability < 0.5 THEN 1 - probability ELSE probability END, 6) AS probability FROM edges"),
    "upsert_elisions": "SELECT DISTINCT 'e:' || sha256(html) AS pointer, octet_length(encode(html))::INTEGER AS n_bytes, sha256(html) AS sha256 FROM pages",
    "cascade_delete": _sql(
        """SELECT part, id, count(*) AS n FROM (SELECT 'memory' AS part, id FROM memory WHERE collection = 'conversation' AND role <> 'assistant'
            UNION ALL SELECT 'edges', src FROM edges WHERE src NOT IN (SELECT id FROM memory WHERE collection = 'conversation' AND role = 'assistant') AND dst NOT IN (SELECT id FROM memory WHERE collection = 'conversation' AND role = 'assistant')
            UNION ALL SELECT 'postings', id FROM postings JOIN memory m USING (id) WHERE m.collection = 'conversation' AND role <> 'assistant') GROUP BY ALL"""
    ),
    "index_tokens": f"SELECT doc_id, len(t)::INTEGER AS n_tokens, sha256(array_to_string(t, ' ')) AS tokens_sha256 FROM (SELECT doc_id, {_tokens('text')} AS t FROM documents)",
    "build_index": _sql("SELECT token, df, n_docs, round(avg_len, 6) AS avg_len FROM dfs, stats"),
    "shortlist_bm25": _sql("SELECT request_id, id, round(score, 6) AS score, rank FROM short", _SHORT),
    "link_candidates": _sql("SELECT request_id AS src, id AS dst, round(score, 6) AS score, rank FROM linked", _LINK),
    "link_edges": _sql(f"SELECT request_id AS src, id AS dst, 'related' AS kind, round(probability, 6) AS probability FROM link_p WHERE probability >= {DEFAULTS.recall_cutoff}", _LINK),
    "neighborhood": _sql("SELECT request_id, id, depth, round(score, 6) AS score, pos FROM near", _shortlist("seeds", "requests", "conversation", 5) | _near("near", "seeds")),
    "lexical_judge": _sql("SELECT request_id, id, probability FROM judged", _FIVE | _judge("judged", "five", "requests")),
    "recall_ranked": _sql("SELECT request_id, id, source_id, probability, rank, cost, used, fits FROM ranked", _RECALL),
    "recall_unranked": _sql(
        """SELECT request_id, id, source_id, pos, NULL::DOUBLE AS probability, true AS unranked FROM cand JOIN memory USING (id)
           WHERE request_id IN (SELECT request_id FROM judged WHERE coalesce(probability, 0) < 0.4) OR request_id NOT IN (SELECT request_id FROM fitting)""",
        _RECALL,
    ),
    "recall_section": _sql("SELECT request_id, sha256(string_agg(label, chr(10) || chr(10) ORDER BY rank)) AS section_sha256 FROM ranked WHERE fits AND label <> '' GROUP BY request_id", _RECALL),
    "recall_rows": _sql(
        """SELECT request_id, 'ok' AS status, CASE WHEN request_id IN (SELECT request_id FROM fitting) THEN count(id) FILTER (WHERE fits) ELSE (SELECT count(*) FROM cand c WHERE c.request_id = requests.request_id) END::INTEGER AS n_passages, coalesce(string_agg(source_id, ',' ORDER BY rank) FILTER (WHERE NOT fits), '') AS over,
            coalesce(sum(cost) FILTER (WHERE fits), 0)::BIGINT AS used_tokens, 2000 AS budget, 'utf8-div-4' AS estimator FROM requests LEFT JOIN ranked USING (request_id) GROUP BY requests.request_id""",
        _RECALL,
    ),
    "recall_request": _sql(
        """SELECT session_id, sha256(string_agg(content, chr(10) || chr(10) ORDER BY seq)) AS request_sha256 FROM (SELECT *, row_number() OVER w AS nth, sum((octet_length(encode(content)) + 3) // 4) OVER w AS run
            FROM (SELECT conv_id AS session_id, seq, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content FROM turns) WHERE content <> '' WINDOW w AS (PARTITION BY session_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING))
           WHERE nth = 1 OR run <= 250 GROUP BY session_id"""
    ),
    "last_user_text": _sql("SELECT session_id, sha256(request) AS request_sha256 FROM asked", _LAST),
    "pressure": _sql(
        f"""SELECT session_id, used_tokens, budget, used_tokens >= budget * {TIGHT.pressure_ratio} AS under_pressure FROM (SELECT session_id, CAST(sum(cost) AS BIGINT) AS used_tokens,
            CASE WHEN session_id % 3 > 0 THEN session_id % 3 * 900 ELSE {TIGHT.token_budget} END::BIGINT AS budget FROM sized GROUP BY session_id)"""
    ),
    "protected_tail": _sql("SELECT session_id, seq, cost, protected FROM tail", _ELIDE),
    "elide": _sql("SELECT session_id, seq, kind, status, elided, sha256(body) AS content_sha256 FROM elided", _ELIDE),
    "expand_pages": _sql(
        """SELECT pointer, page::INTEGER AS page, substr(hex(encode(content)), page * 2000 + 1, 2000) AS data FROM (SELECT pointer, any_value(content) AS content FROM elided WHERE elided GROUP BY pointer),
           range(0, 1000) r(page) WHERE page = 0 OR page * 1000 < octet_length(encode(content))""",
        _ELIDE,
    ),
    "expand": """SELECT page_id, page_id % 10 <> 0 AS found, CASE WHEN page_id % 10 <> 0 THEN sha256(unhex(substr(hex(encode(html)), greatest(page_id % 4 - 1, 0) * 2000 + 1, 2000))) END AS data_sha256 FROM pages""",
    "frozen_prefix": _sql("SELECT session_id, seq, id FROM prefix", _PREFIX),
    "fresh_window": _sql("SELECT session_id, sha256(injection) AS injection_sha256, ids, used_tokens, budget, over FROM windows", _FRESH),
    "prepare_plan": _sql(
        f"""SELECT session_id, 'compacted' AS status, n_context::INTEGER AS n_context, w.used_tokens, budget, over, under_pressure FROM windows w JOIN pressed USING (session_id)
            UNION ALL SELECT session_id, 'fallback', 0, used_tokens, {TIGHT.token_budget}, '', under_pressure FROM pressed WHERE session_id IN (SELECT session_id FROM fallen)""",
        _PREPARE,
    ),
    "host_budget": _sql("SELECT session_id, budget FROM prep", _LOG),
    "select_fresh_cut": _sql("SELECT session_id, first_kept, coalesce(kept_tokens, 0) AS kept_tokens FROM prep LEFT JOIN cut USING (session_id)", _LOG | {"all_in": "SELECT e.*, budget FROM entries e JOIN prep USING (session_id)"} | _cut("cut", "all_in", "50")),
    "deepened_cut": _sql(
        f"""SELECT p.session_id, CASE WHEN 200 + coalesce((SELECT sum(cost) FROM suffix s WHERE s.session_id = p.session_id), 0) <= p.budget THEN first_id ELSE coalesce(first_kept, '{DEFAULTS.window_id}') END AS cut
            FROM prep p LEFT JOIN cut USING (session_id)""",
        _LOG | _cut("cut", "suffix", "200"),
    ),
    "plan_compaction": _sql("SELECT session_id, sha256(text) AS summary_sha256, kept_id AS first_kept_entry_id, tokens_before, fresh_cut FROM final", _COMPACT),
    "fit_summary": _sql(f"SELECT session_id, sha256({_fit('whole', '120')}) AS summary_sha256 FROM (SELECT session_id, array_to_string(context, chr(10) || chr(10)) AS whole FROM plans)", _LOG),
    "compaction_from_plan": _sql("SELECT session_id, sha256(array_to_string(context, chr(10) || chr(10))) AS summary_sha256, first_id AS first_kept_entry_id, tokens_before FROM plans JOIN prep USING (session_id) WHERE status = 'compacted'", _LOG),
    "pack_tool_batches": _sql(f"SELECT session_id, seq, batch::BIGINT AS batch, {_JOINED} AS judged FROM tools_filled WINDOW b AS (PARTITION BY session_id, batch)", _PACK),
    "pack_questions": _sql(_ASKED, _ASK),
    "pack_one_request": _sql(_ASKED, _ASK | {"keyed": "SELECT 'all' AS request_id, 'q' || lpad(doc_id::VARCHAR, 9, '0') AS key, text FROM documents"}),
    "parse_answers": f"SELECT doc_id AS request_id, 'k' AS key, {_P} AS probability, {_V} AS model_version, CASE WHEN doc_id % 4 >= 2 THEN 'parse' END AS error FROM documents",
    "merge_answers": f"""SELECT request_id, key, CASE WHEN error IS NULL THEN p END AS probability, version AS model_version, error FROM
        (SELECT doc_id AS request_id, key, {_P} AS p, {_V} AS version, CASE WHEN doc_id % 8 = 0 THEN 'duplicate' WHEN doc_id % 12 = 1 THEN 'missing' WHEN doc_id % 4 >= 2 THEN 'parse' END AS error
         FROM documents, (VALUES ('k'), ('z')) k(key) WHERE key = 'k' OR doc_id % 12 = 1)""",
    "validate_questions": """SELECT doc_id, kind AS type, CASE WHEN kind = 'guess' OR doc_id % 7 = 0 OR trim(text) = '' THEN 'validation' END AS error
        FROM (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'guess' WHEN 1 THEN 'choice' ELSE 'noul' END AS kind FROM documents)""",
    "normalize_messages": _sql(
        """SELECT conv_id AS session_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS INTEGER) AS seq, 0 AS part, 'm' || seq AS id, role,
           CASE WHEN role = 'system' THEN 'prefix' ELSE 'prose' END AS kind, sha256(text) AS content_sha256 FROM turns"""
    ),
    "candidate_turns": _sql("SELECT arrival, role, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS content_sha256 FROM turns WHERE role IN ('user', 'assistant') AND trim(text) <> ''"),
    "read_turns": _sql("SELECT '/w' AS cwd, session_id, 'src-' || session_id AS source_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INTEGER) AS place, role, sha256(text) AS text_sha256, false AS generated_summary FROM turns"),
    "stored_memory": _sql("SELECT id, collection, source_id, sha256(text) AS sha256, sha256(text) AS text_sha256, session_id, role FROM memory WHERE collection = 'conversation'"),
    "stored_edges": _sql("SELECT src, dst, kind, probability FROM edges"),
    "stored_elisions": "SELECT DISTINCT 'e:' || sha256(html) AS pointer, octet_length(encode(html))::INTEGER AS n_bytes, sha256(html) AS original_sha256 FROM pages",
    "read_judgments": f"""SELECT doc_id::VARCHAR AS request_id, 0 AS batch, CASE doc_id % 4 WHEN 0 THEN '{{"answers":{{"k":{{"noul":' || (doc_id % 10 / 10.0)::DOUBLE || '}}}},"model":"v1"}}'
        WHEN 1 THEN '{{"questions":{{"k":{{"probability":' || (doc_id % 10 / 10.0)::DOUBLE || '}}}},"version":" ","model":"v2"}}' WHEN 2 THEN '{{"answers":{{"k":{{}}}}}}' ELSE 'not json' END AS body FROM documents""",
    "write_plans": _sql("SELECT session_id, status, sha256(array_to_string(context, '|')) AS context_sha256, CASE WHEN session_id % 2 = 0 THEN 'a,b' END AS over FROM plans", _LOG),
    "read_text_sources": _sql("SELECT 'notes' AS collection, session_id AS source_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS INTEGER) AS place, sha256(text) AS sha256 FROM turns"),
    "entry_tokens": _sql(
        """SELECT conv_id AS session_id, seq, ['message', 'compaction', 'branch_summary', 'custom_message', 'model_change'][seq % 5 + 1] AS type, CAST((CASE seq % 5
           WHEN 0 THEN length(CAST(to_json({'role': role, 'content': text}) AS VARCHAR)) WHEN 3 THEN CASE WHEN seq % 2 = 0 THEN length(CAST(to_json({'t': text}) AS VARCHAR)) ELSE 2 END
           WHEN 4 THEN 0 ELSE length(text) END + 3) // 4 AS BIGINT) AS tokens FROM turns"""
    ),
    "text_of": """SELECT doc_id, sha256(CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN text || e'\\nlevel 0' WHEN 2 THEN text || e'\\nlevel 0\\nlevel 1'
        WHEN 5 THEN text || e'\\nlevel 0\\nlevel 1\\nlevel 2\\nlevel 3\\nlevel 4' ELSE '' END) AS text_sha256 FROM documents WHERE text IS NOT NULL""",
    "session_turns": _sql(
        """SELECT conv_id AS session_id, seq, role, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS content_sha256 FROM turns
           WHERE (seq % 3 < 2 OR seq % 5 = 0) AND role IN ('user', 'assistant') AND trim(text) <> ''"""
    ),
    "messages_from_preparation": _sql(
        """SELECT conv_id AS session_id, CAST(nth AS INTEGER) AS seq, 'm' || nth AS id, CASE WHEN role = 'tool' THEN 'tool' ELSE role END AS role,
           CASE role WHEN 'tool' THEN 'tool' WHEN 'system' THEN 'prefix' ELSE 'prose' END AS kind, sha256(text) AS content_sha256
           FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY seq) - 1 AS nth FROM turns WHERE seq < 4)"""
    ),
    "messages_for_compaction": _sql(
        """SELECT conv_id AS session_id, part, CAST(row_number() OVER (PARTITION BY conv_id, part ORDER BY seq) - 1 AS INTEGER) AS seq, role,
           CASE role WHEN 'tool' THEN 'tool' WHEN 'system' THEN 'prefix' ELSE 'prose' END AS kind, sha256(text) AS content_sha256
           FROM (SELECT *, CASE WHEN seq < 4 THEN 0 ELSE 1 END AS part, max(seq) OVER (PARTITION BY conv_id) AS top FROM turns)
           WHERE seq < 4 OR conv_id % 3 = 0 OR (conv_id % 3 = 1 AND seq < 6 AND top >= 6)"""
    ),
    "judge": _sql("SELECT request_id, id, (length(request) * 3 + length(text)) % 100 / 100.0::DOUBLE AS probability FROM five JOIN requests USING (request_id) JOIN memory USING (id)", _FIVE),
    "judge_kept": _sql("SELECT request_id, id, (length(request) * 3 + length(text)) % 100 / 100.0::DOUBLE AS probability FROM five JOIN requests USING (request_id) JOIN memory USING (id)", _FIVE),
    "kept_shortlist": _sql(
        "SELECT request_id, id, round(score, 6) AS score, rank FROM short",
        {"memory": CTES["memory"].replace("SELECT doc_id AS id", "SELECT CASE WHEN source = 'src2' THEN doc_id + 10000000000 ELSE doc_id END AS id").replace(
            "source AS source_id, text,", "source AS source_id, CASE WHEN source = 'src2' THEN text || ' once again' ELSE text END AS text,").replace("FROM documents", "FROM documents WHERE source <> 'src1'")}
        | _SHORT,
    ),
    "links_of_the_moment": _sql(
        f"""SELECT request_id AS src, id AS dst, round(score, 4) AS score, CAST(row_number() OVER w AS INTEGER) AS rank FROM moment_s
            WINDOW w AS (PARTITION BY request_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= {DEFAULTS.link_seeds}""",
        {
            "newer": _LINK["newer"],
            "linked_q": _LINK["linked_q"],
            "df_then": "SELECT id AS request_id, token, row_number() OVER (PARTITION BY token ORDER BY id) AS df FROM postings",
            "moment": "SELECT id AS request_id, row_number() OVER (ORDER BY id) AS n_docs, sum(n) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) / row_number() OVER (ORDER BY id) AS avg_len FROM lengths",
            "moment_s": """SELECT request_id, id, round(sum(mult * CASE WHEN n_docs - df + 0.5 <= df + 0.5 THEN 1e-6 ELSE ln((n_docs - df + 0.5) / (df + 0.5)) END
                * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / avg_len))), 9) AS score
                FROM linked_q JOIN df_then USING (request_id, token) JOIN moment USING (request_id) JOIN postings USING (token) JOIN lengths USING (id)
                WHERE collection = 'conversation' AND id < request_id GROUP BY ALL""",
        },
    ),
    "capture_batches": _sql(
        """SELECT row_number() OVER (ORDER BY batch, arrival) AS id, 'conversation' AS collection, session_id AS source_id, hash AS sha256, session_id, role
           FROM (SELECT *, CASE WHEN conv_id % 3 < 2 THEN 0 ELSE 1 END AS batch, sha256(text) AS hash FROM turns WHERE role IN ('user', 'assistant') AND trim(text) <> '')
           QUALIFY row_number() OVER (PARTITION BY hash ORDER BY batch, arrival) = 1"""
    ),
    "recall_batches": _sql(
        "SELECT request_id, CAST(request_id % 2 AS INTEGER) AS batch, sha256(string_agg(label, chr(10) || chr(10) ORDER BY rank)) AS section_sha256 FROM ranked WHERE fits AND label <> '' GROUP BY request_id",
        _shortlist("asked_c", "requests", "conversation", DEFAULTS.shortlist_limit)
        | _near("near", "asked_c")
        | {"cand": "SELECT request_id, id, pos FROM near"}
        | _judge("judged", "cand", "requests")
        | _FITTING
        | _ranked("ranked", "fair", DEFAULTS.inject_budget),
    ),
}
ORACLES |= {"replace_stored": ORACLES["replace_source"], "expand_stored": ORACLES["expand"]}
