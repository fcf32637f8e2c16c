"""Stores that are kept on disk: their hashes, replaced sources and payload pages."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import compact, hash_table, judging, kept_index, kept_store, store
from tessera.schemas import MEMORY, TURNS
from tessera.sources import tables
from tessera.streaming import streams


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _memory(spark, rows):
    """Rows (id, collection, source_id, text)."""
    return spark.createDataFrame([(i, c, s, t, t and _sha(t), None, None, "", "", "user") for i, c, s, t in rows], MEMORY)


def _turns(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "user", "", "s", None, False) for i, t in enumerate(texts)], TURNS)


def _found(spark, path, texts, collection=None):
    asked = spark.createDataFrame([(_sha(t),) for t in texts], "sha256 string")
    return sorted(r.sha256 for r in hash_table.stored_hashes(asked, path, collection).collect())


@pytest.mark.parametrize("bucket,slice_,folders", [(1 << 20, 200_000, 4096), (16, 50, 4096), (16, 50, 1), (16, 2, 4096)])
def test_hashes_follow_adds_and_removals(spark, tmp_path, monkeypatch, bucket, slice_, folders):
    for name, value in (("BUCKET", bucket), ("SLICE", slice_), ("MAX_FOLDERS", folders), ("MAX_SLICES", 8)):
        monkeypatch.setattr(hash_table, name, value)
    path = str(tmp_path / "hashes")
    first = _memory(spark, [(i, "default", "a", f"text {i % 60}") for i in range(80)] + [(900, "default", "a", None)])
    second = _memory(spark, [(100 + i, "conversation", "b", f"text {50 + i}") for i in range(40)])
    asked = [f"text {i}" for i in range(0, 120, 3)]
    assert _found(spark, path, asked) == []
    assert hash_table.follow_hashes(first, path) and not hash_table.follow_hashes(first, path)
    assert hash_table.add_hashes(second, path, "b") and not hash_table.add_hashes(second, path, "b") and not hash_table.add_hashes(first.limit(0), path)
    assert not hash_table.follow_hashes(first.unionByName(second), path)
    assert _found(spark, path, asked) == sorted(_sha(f"text {i}") for i in range(0, 90, 3))
    assert _found(spark, path, asked, "conversation") == sorted(_sha(f"text {i}") for i in range(51, 90, 3))
    # text 0 to 19 stand twice in the first rows: one row of each remains
    assert hash_table.add_hashes(first.where("id < 40"), path, "gone", removed=True)
    assert _found(spark, path, asked) == sorted(_sha(f"text {i}") for i in [*range(0, 20, 3), *range(42, 90, 3)])
    assert not hash_table.follow_hashes(first.where("id >= 40").unionByName(second), path)


def test_sets_are_merged_and_unknown_writes_are_noticed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hash_table, "MERGE", 3)
    path = str(tmp_path / "hashes")
    rows = [_memory(spark, [(i, "default", "a", f"text {i}")]) for i in range(7)]
    for i, row in enumerate(rows):
        hash_table.add_hashes(row, path, str(i))
    sets = hash_table._sets(hash_table.read_log(spark, path))
    assert len(sets) < 4 and sum(s["keys"] for s in sets) == 7
    assert _found(spark, path, [f"text {i}" for i in range(9)]) == sorted(_sha(f"text {i}") for i in range(7))
    other = _memory(spark, [(i, "default", "a", f"text {i}") for i in range(5, 9)])
    assert hash_table.follow_hashes(other, path)
    assert _found(spark, path, [f"text {i}" for i in range(9)]) == sorted(_sha(f"text {i}") for i in range(5, 9))


@pytest.mark.parametrize("scope", ["global", "conversation"])
def test_ingest_by_hashes_equals_ingest_by_store(spark, tmp_path, scope):
    path = str(tmp_path / "hashes")
    memory = _memory(spark, [(i, "default" if i % 2 else "conversation", "a", f"said {i}") for i in range(30)])
    hash_table.follow_hashes(memory, path)
    turns = _turns(spark, [f"said {i}" for i in range(20, 45)] * 2 + ["", None, " "])
    rows = lambda df: sorted(map(tuple, df.select("arrival", "sha256", "source_id", "session_id").collect()))
    want = rows(store.ingest_new(turns, memory, scope))
    assert rows(store.ingest_new(turns, memory.limit(0), scope, hashes=path)) == want and want
    assert store.ingest_new(turns.limit(0), memory, scope, hashes=path).count() == 0


def test_the_stores_side_is_not_exchanged(spark, tmp_path, monkeypatch):
    """Only buckets that may hold a hash are read, and between the read and the counts there is no exchange of whole sides."""
    monkeypatch.setattr(hash_table, "BUCKET", 100)
    path = str(tmp_path / "hashes")
    hash_table.follow_hashes(spark.range(20_000).select("id", F.lit("default").alias("collection"), F.sha2(F.col("id").cast("string"), 256).alias("sha256")), path)
    asked = spark.createDataFrame([(_sha("7"),), (_sha("never"),)], "sha256 string")
    found = hash_table.stored_hashes(asked, path)
    assert [r.sha256 for r in found.collect()] == [_sha("7")]
    assert len({os.path.dirname(f) for f in found.inputFiles() if "/rows/" in f}) <= 2
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_batch_that_failed_before_its_hashes_stores_nothing_twice(spark, tmp_path, monkeypatch):
    at, edges = str(tmp_path / "memory"), str(tmp_path / "edges")
    streams.capture_batch(_turns(spark, ["one two", "two three"]), at, edges, judging.lexical_judge, name="c/0")
    batch = _turns(spark, ["three four", "one two"], 10)
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(streams, "add_hashes", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        streams.capture_batch(batch, at, edges, judging.lexical_judge, name="c/1")
    for _ in range(2):
        streams.capture_batch(batch, at, edges, judging.lexical_judge, name="c/1")
    assert sorted((r.id, r.text) for r in tables.read_memory(spark, at).collect()) == [(1, "one two"), (2, "two three"), (3, "three four")]
    assert kept_index.open_index(spark, streams.index_path(at)).n_docs == 3


def test_links_are_looked_for_until_they_are_judged(spark, tmp_path):
    """Rows that got no edge are not linked again with each delivery; those with a failed judgment are."""
    at, edges, asked = str(tmp_path / "memory"), str(tmp_path / "edges"), []

    def judge(pairs):
        asked.append(pairs.count())
        return pairs.withColumn("probability", F.lit(None if len(asked) == 1 else 0.1).cast("double"))

    for _ in range(3):
        streams.capture_batch(_turns(spark, ["one two", "two three", "three one"]), at, edges, judge)
    assert asked == [3, 3]
    assert tables.read_edges(spark, edges).count() == 0


def test_an_id_is_the_place_among_the_delivered_turns(spark, tmp_path):
    """As in the SQL of capture_batches: a duplicate's number stays unused, a turn delivered again takes none."""
    at, edges = str(tmp_path / "memory"), str(tmp_path / "edges")
    judge = lambda pairs: pairs.withColumn("probability", F.lit(0.1))
    texts = ["one two", "one two", "two three", "three one", "one two", "four five"]
    for part in (slice(0, 3), slice(2, 6), slice(2, 6)):
        streams.capture_batch(_turns(spark, texts).where(F.col("arrival").isin(list(range(*part.indices(6))))), at, edges, judge)
    assert sorted((r.id, r.text) for r in tables.read_memory(spark, at).collect()) == [(1, "one two"), (3, "two three"), (4, "three one"), (6, "four five")]


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def _rows(df):
    return sorted(map(repr, df.collect()))


def test_a_replaced_source_rewrites_its_folder_only(spark, tmp_path):
    path = str(tmp_path / "memory")
    old = _memory(spark, [(i, "default" if i % 3 else "conversation", f"s{i % 11}", f"text {i}") for i in range(90)] + [(200, "default", None, "no source"), (201, "odd = /x", "s1", "text")])
    tables.write_memory(old, path)
    before = _files(path)
    new = _memory(spark, [(300, "default", "s4", "new one"), (301, "default", "s4", "new two"), (302, "default", "never seen", "first")])
    gone = kept_store.replace_stored(new, path)
    want = store.replace_source(old, new)
    assert _rows(tables.read_memory(spark, path).select(want.columns)) == _rows(want)
    assert sorted(r.id for r in gone.collect()) == [i for i in range(90) if i % 3 and i % 11 == 4]
    own = {f"collection=default/source_bucket={r.b}" for r in new.select(tables.source_bucket(F.col("source_id"), 16).alias("b")).collect()}
    assert {os.path.relpath(os.path.dirname(f), path) for f in before ^ _files(path)} <= own
    again = kept_store.replace_stored(new, path)
    assert again.count() == 2 + 1 and _rows(tables.read_memory(spark, path).select(want.columns)) == _rows(want)


def test_emptied_sources_leave_no_rows_behind(spark, tmp_path):
    path = str(tmp_path / "memory")
    old = _memory(spark, [(1, "odd = /x", "only", "a"), (2, "default", None, "b"), (3, "default", "s", "c")])
    tables.write_memory(old, path, buckets=4)
    tables.write_memory(_memory(spark, [(4, "default", "s", "d")]), path, buckets=32)
    gone = old.where("id < 3").select("collection", "source_id")
    assert kept_store.replace_stored(old.limit(0), path, gone).count() == 2
    assert sorted(r.id for r in tables.read_memory(spark, path).collect()) == [3, 4]
    assert sorted(r.id for r in tables.read_memory(spark, path, "default", "s").collect()) == [3, 4]
    assert kept_store.replace_stored(_memory(spark, [(5, "default", "s", "e")]), path).count() == 2
    assert [r.id for r in tables.read_memory(spark, path, "default", "s").collect()] == [5]
    assert kept_store.replace_stored(old.limit(0), path).count() == 0


@pytest.mark.parametrize("literal", [64, 2])
def test_stored_pages_equal_expand(spark, tmp_path, monkeypatch, literal):
    monkeypatch.setattr(kept_store, "LITERAL", literal)
    path = str(tmp_path / "pages")
    payloads = spark.createDataFrame([(f"e:{i}", bytes(f"{i}" * (i * 7), "ascii"), "") for i in range(12)], "pointer string, original binary, sha256 string")
    kept_store.write_pages(payloads, path, 10)
    kept_store.write_pages(payloads.where("pointer = 'e:3'"), path, 10)
    asked = spark.createDataFrame([(n, f"e:{i}" if i < 13 else None, p, "x") for n, (i, p) in enumerate([(3, 0), (3, 0), (3, 2), (3, 99), (5, -4), (0, 0), (0, 1), (12, 0), (13, 0), (11, 3)])], "n int, pointer string, page int, data string")
    asked = asked.drop("data")
    assert _rows(kept_store.expand_stored(asked, path).select("n", "pointer", "page", "found", "data")) == _rows(compact.expand(asked, payloads, 10).select("n", "pointer", "page", "found", "data"))
    assert kept_store.expand_stored(asked.limit(0), path).count() == 0


def test_a_page_is_read_without_its_payload(spark, tmp_path):
    """Of a payload of 30 MB that does not compress one page is read."""
    path = str(tmp_path / "pages")
    body = os.urandom(30 << 20)
    kept_store.write_pages(spark.createDataFrame([("e:big", body, "")], "pointer string, original binary, sha256 string"), path)
    tracker = spark.sparkContext._jsc.sc().statusStore()
    read = lambda: tracker.executorSummary("driver").totalInputBytes()
    before = read()
    row = kept_store.expand_stored(spark.createDataFrame([("e:big", 4000)], "pointer string, page int"), path).first()
    assert bytes(row.data) == body[4000 * 4096 : 4001 * 4096] and read() - before < 3 << 20


def test_index_and_hashes_follow_replaced_sources(spark, tmp_path):
    at, edges = str(tmp_path / "memory"), str(tmp_path / "edges")
    marked = lambda: (kept_index.open_index(spark, streams.index_path(at)).n_docs, _found(spark, streams.hashes_path(at), ["red boat", "old text", "new text", "blue boat"]))
    streams.replace_sources(_memory(spark, [(1, "default", "s", "red boat"), (2, "default", "t", "old text")]), at)
    assert marked() == (2, sorted([_sha("red boat"), _sha("old text")]))
    new = _memory(spark, [(2, "default", "t", "new text"), (4, "default", "t", "blue boat")])
    for _ in range(2):
        streams.replace_sources(new, at)
        assert marked() == (3, sorted([_sha("red boat"), _sha("new text"), _sha("blue boat")]))
    streams.capture_batch(_turns(spark, ["old text", "red boat"]), at, edges, judging.lexical_judge)
    assert [(r.id, r.text) for r in tables.read_memory(spark, at, "conversation").collect()] == [(5, "old text")]
    streams.replace_sources(new.limit(0), at, new.select("collection", "source_id"))
    assert marked() == (2, sorted([_sha("red boat"), _sha("old text")]))
