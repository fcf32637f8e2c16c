"""Conversation repair, Merkle manifests and reply trees against brute force and on the awkward cases."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle, queries, repair, reply_trees

TURNS = "conv_id long, turn long, role string, text string, seg string, g long"


def cheapest(kinds):
    """(cost, edits) by a search forward over all edits, from the contract alone."""
    step = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}
    best = {"": (0, "")}

    def better(found, state, way):
        if state not in found or way < found[state]:
            found[state] = way

    def inserted(found):
        for _ in range(4):
            for state, (cost, edits) in list(found.items()):
                for role in "ua":
                    if state in step[role]:
                        better(found, role, (cost + 3, edits + "I"))
        return found

    for k in kinds:
        nxt = {}
        role, fault = "suao"[repair.KINDS.index(k) % 4], repair.KINDS.index(k) // 4
        for state, (cost, edits) in inserted(best).items():
            better(nxt, state, (cost + 4, edits + "D"))
            if fault < 2:
                extra = 3 * (fault == 1)
                if role in step and state in step[role]:
                    better(nxt, role, (cost + extra, edits + "K"))
                for to in "ua":
                    if to != role and state in step[to]:
                        better(nxt, to, (cost + extra + 3, edits + "R"))
        best = nxt
    ends = inserted(best)
    return min(ends[s] for s in ("", "a") if s in ends)


def test_walk_is_the_cheapest_and_ascii_least():
    rng = random.Random(3)
    for _ in range(3000):
        kinds = "".join(rng.choices(repair.KINDS, weights=[3, 6, 6, 2] + [1] * 8, k=rng.randrange(0, 13)))
        edits, _, _, cost = repair.walk(kinds, repair.START, repair.AFTER_LAST, True)
        assert (cost, edits) == cheapest(kinds), kinds


def _expected(rows):
    """Report and repaired lines of one conversation's rows, in order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], sha256(r[2].encode()).hexdigest()))
    seen, kinds, counts = set(), "", [0, 0, 0]
    for _, role, text in rows:
        kept = text.rstrip(repair.BLANKS)
        fault = 2 if not kept else 3 if (role, text) in seen else 1 if kept[-1] not in ".!?" else 0
        seen.add((role, text))
        if fault:
            counts[{2: 0, 3: 1, 1: 2}[fault]] += 1
        kinds += repair.KINDS[("sua".find(role[:1]) if role[:1] else -1) % 4 + 4 * min(fault, 2)]
    cost, edits = cheapest(kinds)
    n, at, out = len(edits.replace("D", "")), 0, []
    for e in edits:
        row = rows[at] if e != "I" else None
        at += e != "I"
        if e != "D":
            role = row[1] if e == "K" else "user" if (len(out) + n % 2) % 2 == 0 else "assistant"
            out.append(f"{role}:{row[2] if row else ''}")
    said = ["sua"["sua".find(r[1][:1])] if r[1][:1] in ("s", "u", "a") else "?" for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *counts, illegal, cost, edits), out


def _check_repair(spark, data, segment):
    df = spark.createDataFrame(data, TURNS)
    report, edits = repair.repair_conversations(df, segment)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in report.collect()}
    lines = defaultdict(list)
    for r in edits.where("edit <> 'D'").orderBy("conv_id", "seg", "step").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in data:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(groups)
    for conv, rows in groups.items():
        want, out = _expected(rows)
        assert got[conv] == want, conv
        assert lines[conv] == out, conv


def _random_turns(seed):
    rng = random.Random(seed)
    data = []
    for conv in [None, *range(8)]:
        for turn in range(rng.choice([1, 2, 5, 40])):
            at = rng.choice([turn, turn, turn, None, turn // 2])
            text = rng.choice([f"Fine {turn}.", f"cut {turn}", "Same.", "", None, " \t", "!?", "x. "])
            data += [(conv, at, rng.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""]), text, "clash", 7)] * rng.choice([1, 1, 1, 2])
    return data


def test_repair_equals_the_search(spark):
    _check_repair(spark, _random_turns(5), None)


def test_long_conversations_are_repaired_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repair, "FAN", 2)
    _check_repair(spark, _random_turns(6), 3)


def test_repair_of_very_long_text_and_of_nothing(spark):
    _check_repair(spark, [(1, 0, "user", "word " * 200_000, "", 0), (1, 1, "assistant", "end.", "", 0)], None)
    report, edits = repair.repair_conversations(spark.createDataFrame([], TURNS))
    assert report.count() == edits.count() == 0


def test_op11_returns_every_conversation(spark):
    data = [(c, 0, "user", "One. Two") for c in range(60)] + [(None, None, None, None)]
    path = _written(spark, "conversations", data, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in queries.op11_repair(spark, path).collect()}
    assert set(got) == {c for c, *_ in data}
    dropped = [c for c in range(60) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert dropped
    for c in dropped:
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())


def _written(spark, name, rows, schema):
    import tempfile

    path = tempfile.mkdtemp(prefix="tessera-test-")
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


def _h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def _tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([_h(*at[i : i + 2]) for i in range(0, len(at), 2)])
    return levels


def _siblings(levels, i):
    out = []
    for at in levels[:-1]:
        pair = at[i & ~1 : (i & ~1) + 2]
        out.append((i & 1, [x for j, x in enumerate(pair) if j != (i & 1)]))
        i >>= 1
    return out


def _manifest(rows):
    """All rows of a manifest by brute force; rows are (key, group, leaf, changed)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        trees[g] = _tree([r[2] for r in groups[g]])
    top = _tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (key, _, leaf, changed) in enumerate(groups[g]):
            path = _siblings(trees[g], i) + _siblings(top, k)
            at = changed or leaf
            for side, others in path:
                at = _h(*((others + [at]) if side else ([at] + others)))
            root = top[-1][0]
            out.append((key, g, leaf, trees[g][-1][0], root, _h(*(x for _, others in path for x in others)), at, at == root))
    return out


LEAVES = "key long, grp string, leaf string, changed string, node string, g string"


@pytest.mark.parametrize("height", [1, 2, 5, None])
def test_manifest_equals_one_big_tree(spark, height):
    rng = random.Random(height or 9)
    rows = [(k, g, _h(f"{g}/{k}"), _h("other") if k % 3 == 0 else None, "x", "y") for g, n in [("en", 37), ("é", 8), (None, 5), ("z", 1), ("", 2)] for k in range(n)]
    rows += [(None, "en", _h("null key"), None, "", ""), (4, "en", _h("en/4"), None, "", ""), (4, "en", _h("else"), None, "", "")]
    rng.shuffle(rows)
    got = [tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, LEAVES), "grp", "key", height).collect()]
    by = lambda r: tuple(map(str, r))
    assert sorted(got, key=by) == sorted(_manifest([r[:4] for r in rows]), key=by)


def test_manifest_of_one_leaf_and_of_none(spark):
    one = merkle.manifest(spark.createDataFrame([(1, None, _h("a"), None, "", "")], LEAVES), "grp", "key").first()
    assert (one.subroot, one.root, one.proof, one.folded, one.verified) == (_h("a"), _h("a"), _h(), _h("a"), True)
    assert merkle.manifest(spark.createDataFrame([], LEAVES), "grp", "key").count() == 0


def test_op12_tells_tampered_rows(spark):
    docs = [(i, f"t é{i}", ["en", None][i % 2], None if i % 5 == 0 else "s", None if i % 11 == 0 else i, "clash") for i in range(60)] + [(None, None, "de", "s", 3, ""), (7, "long " * 100_000, "de", "", 2**63 - 1, "")]
    path = _written(spark, "documents", docs, "doc_id long, text string, lang string, source string, n_chars long, leaf string")
    rows = []
    for i, text, lang, source, n, _ in docs:
        part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
        leaf = lambda n: _h(*map(part, (i, source, lang, n, text)))  # noqa: B023, E731
        rows.append((i, lang, leaf(n), leaf(n + 1) if i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0 else None))
    want = sorted(((r[0], *r[2:]) for r in _manifest(rows)), key=str)
    got = sorted((tuple(r) for r in queries.op12_merkle(spark, path).collect()), key=str)
    assert got == want and {r[-1] for r in got} == {True, False}


MESSAGES = "conv_id long, msg_id long, parent_id long, role string, text string, score double, n long, up long"


def _branches(spark, rows, **how):
    out = defaultdict(list)
    for r in reply_trees.format_replies(spark.createDataFrame(rows, MESSAGES), **how).orderBy("conv_id", "branch", "part", "piece").collect():
        turns = reply_trees.read_turns(r.formatted)
        assert [reply_trees.unescape(r.formatted[s.begin : s.end]) for s in r.loss] == [t for role, t in turns if role == "assistant"]
        out[r.conv_id, r.branch, r.score] += turns
    return dict(out)


def _all_paths(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = {r[1]: r for r in rows if r[0] == conv}
        parents = {r[2] for r in mine.values()}
        found = []
        for m in mine:
            if m not in parents:
                path, at = [], m
                while at in mine:
                    path.insert(0, at)
                    at = mine[at][2]
                score = round(sum(mine[x][5] or 0 for x in path) / len(path), 9)
                found.append((-score, m, path))
        for i, (worst, _, path) in enumerate(sorted(found)):
            out[conv, i + 1, -worst] = [(mine[x][3] or "", mine[x][4] or "") for x in path]
    return out


def test_paths_ranks_and_round_trip(spark, monkeypatch):
    monkeypatch.setattr(reply_trees, "PART_TURNS", 3)
    monkeypatch.setattr(reply_trees, "PART_CHARS", 40)
    rng = random.Random(1)
    texts = ["", None, "<|im_end|>", "<\\|x", "a\n<|im_start|>user\nb", "<<|", "\\", "é𝄞" * 30, "plain"]
    rows = []
    for conv in [None, 1, 2]:
        for m in range(25):
            parent = None if m == 0 or rng.random() < 0.05 else rng.choice([m - 1, rng.randrange(m), 900])
            rows.append((conv, m, parent, rng.choice(["user", "assistant", None, "a\\n\nb<|"]), rng.choice(texts), rng.choice([None, 0.0, 0.5, 1.0, 0.25]), 1, 2))
    want = _all_paths(rows)
    assert _branches(spark, rows) == want
    assert _branches(spark, rows, branches=2) == {k: v for k, v in want.items() if k[1] <= 2}


def test_cycles_repeated_ids_and_nothing(spark):
    row = lambda c, m, p, t: (c, m, p, "user", t, float("nan"), 0, 0)
    rows = [row(1, 5, 7, "five"), row(1, 6, 5, "six"), row(1, 7, 6, "seven"), row(1, 3, 7, "tail"), row(1, 2, 2, "self"), row(2, 1, None, "r"), row(2, 2, 1, "x"), row(2, 2, 1, "x"), row(2, 3, 2, "z")]
    got = {k[:2]: [t for _, t in v] for k, v in _branches(spark, rows).items()}
    assert got == {(1, 1): ["self"], (1, 2): ["five", "six", "seven", "tail"], (2, 1): ["r", "x"], (2, 2): ["r", "x", "z"]}
    assert reply_trees.format_replies(spark.createDataFrame([], MESSAGES)).count() == 0
    with pytest.raises(ValueError):
        reply_trees.read_turns("<|im_start|>user\nno end")


def test_threads_put_ties_and_nulls_in_order(spark):
    rows = [(1, None, "user", "n"), (1, 2, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, None, "alone")]
    made = reply_trees.format_replies(reply_trees.threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), cycles=False)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars) for r in queries.read_back(made).collect()}
    assert got == {1: (4, _h("user\nn\nassistant\na\nassistant\na\nuser\n\n"), 2), None: (1, _h("\nalone\n"), 0)}


def test_new_queries_on_sf001(spark):
    shown = queries.op13_reply_trees(spark, "/root/testdata/sf0.001")
    planted = shown.where("conv_id = -1").first()
    assert (planted.n_turns, planted.loss_chars) == (2, len(queries.PLANTED))
    assert planted.loss_sha256 == _h(queries.PLANTED)
    assert shown.where(F.col("n_turns") < 1).count() == 0
