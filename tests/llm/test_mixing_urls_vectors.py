"""Mixing, url filter and the vector searches against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import curve_ann, mixing, pivot_topk, queries, url_filter

VECTORS = "vec_id long, embedding array<float>"


def _vectors(n, dims=16, seed=0):
    return [(i, x.astype(np.float32).tolist()) for i, x in enumerate(np.random.default_rng(seed).normal(size=(n, dims)))]


def _brute(rows, score, k=5, every=50):
    out = []
    for q, v in rows:
        if q % every == 0:
            best = sorted(((-score(v, w), c) for c, w in rows if c != q))[:k]
            out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(best)]
    return out


def _product(v, w):
    f = lambda z: [math.floor(256 * float(x)) for x in z]
    return sum(a * b for a, b in zip(f(v), f(w)))


@pytest.mark.parametrize("copies", [0, 40])
def test_pivot_search_is_exact(spark, copies, monkeypatch):
    monkeypatch.setattr(pivot_topk, "BLOCK", 64)
    monkeypatch.setattr(pivot_topk, "QUERY_BLOCK", 3)
    rows = _vectors(300)
    rows += [(300 + i, rows[50][1]) for i in range(copies)]
    odd = [(1000, None), (1050, [float("nan")] * 16), (1100, []), (1150, [None] * 16)]
    got = pivot_topk.top_products(spark.createDataFrame(rows + odd, VECTORS)).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == _brute(rows, _product)


def test_pivot_blocks_out_of_reach_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "BLOCK", 50)
    monkeypatch.setattr(pivot_topk, "QUERY_BLOCK", 2)
    kept, pairs = [], pivot_topk._pairs
    monkeypatch.setattr(pivot_topk, "_pairs", lambda *a: kept.append((pairs(*a), a[2])) or kept[-1][0])
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(20, 8))
    centres /= np.sqrt((centres**2).sum(axis=1))[:, None]
    rows = [(i, (50 * centres[i % 20] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(1000)]
    got = pivot_topk.top_products(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == _brute(rows, _product)
    found, blocks = kept[0]
    assert found.count() < 0.5 * blocks * found.select("lot").distinct().count()


def test_vector_searches_with_repeated_ids_and_odd_lengths(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [1.0]), (3, [0.5, 1.0]), (None, [1.0, 1.0])]
    docs = spark.createDataFrame([(*r, "old", 7) for r in rows], VECTORS + ", rep string, score int")
    assert [(r.query_id, r.vec_id) for r in curve_ann.nearest(docs).orderBy("rank").collect()] == [(0, 3), (0, 1)]
    assert [(r.query_id, r.vec_id, r.score) for r in pivot_topk.top_products(docs).orderBy("rank").collect()] == [(0, 1, 65536), (0, 3, 65536)]


def test_pivot_bounds_stop_early():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 2000
    x = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(1000, 8)) * 5).astype(np.int64)
    pivots = pivot_topk.choose_pivots(x.astype(float), 16)
    table, q = pivot_topk.to_pivots(x, pivots), x[123]
    ids, score, looked = pivot_topk.search(x, np.arange(1000), table, q, pivot_topk.to_pivots(q[None], pivots)[0], 6, None)
    every = x @ q
    want = np.lexsort((np.arange(1000), -every))[:6]
    assert ids.tolist() == want.tolist() and score.tolist() == every[want].tolist() and looked < 1000


def test_hilbert_curve_visits_neighbours():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    key = curve_ann.hilbert(grid, 3)
    assert sorted(key.tolist()) == list(range(side**3))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("shape", ["noise", "clusters"])
def test_curve_search_recall(spark, shape, monkeypatch):
    monkeypatch.setattr(curve_ann, "BLOCK", 128)
    monkeypatch.setattr(curve_ann, "LEAST_WINDOW", 16)
    monkeypatch.setattr(curve_ann, "QUERY_LOT", 7)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    if shape == "clusters":
        x = np.repeat(rng.normal(size=(150, 24)), 20, axis=0) + 0.05 * x
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    rows += [(3000 + i, rows[0][1]) for i in range(30)] + [(4000, [0.0] * 24), (4050, None)]
    got = curve_ann.nearest(spark.createDataFrame(rows, VECTORS)).orderBy("query_id", "rank").collect()
    v = np.array([r[1] for r in rows[:3030]], np.float64)
    sims = (v @ v.T) / np.sqrt((v * v).sum(1))[:, None] / np.sqrt((v * v).sum(1))
    hit, total = 0, 0
    for q in range(0, 3030, 50):
        sims[q, q] = -2
        want = np.lexsort((np.arange(3030), -sims[q].round(12)))[:5]
        mine = [r for r in got if r.query_id == q]
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert np.allclose([r.score for r in mine], sims[q][[r.vec_id for r in mine]], atol=1e-12)
        hit, total = hit + len(set(want.tolist()) & {r.vec_id for r in mine}), total + 5
    assert hit / total >= 0.9
    assert [r.vec_id for r in got if r.query_id == 0] == [3000, 3001, 3002, 3003, 3004]


def test_curve_search_names_a_pair_once_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(curve_ann, "BLOCK", 700)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(250, 64)), 20, axis=0) + 0.05 * rng.normal(size=(5000, 64))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    got = {}
    for r in curve_ann.nearest(spark.createDataFrame(rows, VECTORS), every=10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    v = np.array([r[1] for r in rows], np.float64)
    v /= np.sqrt((v * v).sum(1))[:, None]
    hit = 0
    for q in range(0, 5000, 10):
        assert sorted(got[q]) == [1, 2, 3, 4, 5] and len(set(got[q].values())) == 5 and q not in got[q].values()
        sims = v @ v[q]
        sims[q] = -2
        hit += len(set(np.argsort(-sims)[:5].tolist()) & set(got[q].values()))
    assert hit >= 0.9 * 2500


def test_vector_searches_on_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert curve_ann.nearest(empty).count() == 0 and pivot_topk.top_products(empty).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0])], VECTORS)
    assert [tuple(r)[:3] for r in curve_ann.nearest(few).collect()] == [(0, 1, 1)]
    assert [tuple(r) for r in pivot_topk.top_products(few).collect()] == [(0, 1, 1, 65536)]


def test_url_filter_in_segments(spark):
    urls = ["http://A.Example.org/es/x?q", "https://m.bad.net#top", None, "no url", "http://x.org?y", "http://com/fr/", "ftp://a.com/de/1", "http://b.com/en", "http://notorg/"]
    pages = spark.createDataFrame([(i, u, "kept", "old") for i, u in enumerate(urls)], "page_id long, url string, extra string, rule string")
    hosts = spark.createDataFrame([("bad.net",), (None,), ("never.seen",)], "host string")
    want = [("a.example.org", "/es/x", "example.org/es/", "block"), ("m.bad.net", "", None, "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("x.org", "", None, "allow"),
            ("com", "/fr/", "com/fr/", "allow"), ("a.com", "/de/1", "com/de/", "block"), ("b.com", "/en", None, "allow"), ("notorg", "/", None, "allow")]
    for words in (url_filter.SEGMENT_WORDS, 1):
        got = url_filter.filter_urls(pages, queries.URL_RULES, hosts, segment_words=words).orderBy("page_id").collect()
        assert [(r.host, r.path, r.rule, r.verdict) for r in got] == want and {r.extra for r in got} == {"kept"}
    assert url_filter.filter_urls(pages.limit(0), queries.URL_RULES, hosts).count() == 0
    odd = spark.createDataFrame([(1, "http://a.org/x|y/z"), (1, "http://a.org/x|y/z"), (2, "http://a.org/" + "p" * 300000)], "page_id long, url string")
    got = url_filter.filter_urls(odd, [("a.org", "/x|y/", "block"), ("a.org", "/x", "allow")], hosts).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [("a.org/x|y/", "block")] * 2 + [(None, "allow")]


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.Cascade(keys)
    assert len(cascade.levels) >= 2
    wrong = cascade.attach(keys).where(cascade.holds(F.col("key")) != F.col("listed")).count()
    assert wrong == 0


def test_raked_weights_meet_the_marginals(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(1, 500))) for a in range(4) for b in range(3) for c in range(3)]
    cells = spark.createDataFrame(rows, "_source string, _lang string, _topic string, _tokens long")
    targets = {"source": {"s0": 4, "s1": 3, "s2": 2, "s3": 1, "absent": 9}, "lang": {"l0": 1, "l1": 1, "l2": 2}}
    got = {(r._source, r._lang, r._topic): r.weight for r in mixing.rake(cells, targets).collect()}
    w = np.zeros((4, 3, 3))
    for (a, b, c), v in got.items():
        w[int(a[1]), int(b[1]), int(c[1])] = v
    assert np.allclose(w.sum((1, 2)), [0.4, 0.3, 0.2, 0.1], atol=1e-5) and np.allclose(w.sum((0, 2)), [0.25, 0.25, 0.5], atol=1e-5)
    n = np.zeros((4, 3, 3))
    for a, b, c, v in rows:
        n[int(a[1]), int(b[1]), int(c[1])] = v
    fit, topic = n / n.sum(), np.sqrt(n.sum((0, 1)))
    for _ in range(200):
        fit *= (np.array([0.4, 0.3, 0.2, 0.1]) / fit.sum((1, 2)))[:, None, None]
        fit *= (np.array([0.25, 0.25, 0.5]) / fit.sum((0, 2)))[None, :, None]
        fit *= (topic / topic.sum() / fit.sum((0, 1)))[None, None, :]
    assert np.allclose(w, fit, atol=1e-5)


def test_mixing_cases(spark):
    rows = [(i, "w " * 50, "en", "a" if i % 10 else "b") for i in range(2000)] + [(5000, None, None, None), (5001, "", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("weight", F.lit("old"))
    got = mixing.mix_sources(docs, {"source": {"a": 1, "b": 1}})
    kept = {r._source: r["count"] for r in got.where("kept").groupBy("_source").count().collect()}
    assert kept["b"] == 200 and 140 < kept["a"] < 260
    assert got.where("doc_id = 5000").first()._source == "unknown"
    assert got.count() == 2002 and mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.token_counts(pa.array(["a  b\tc\n", "", None, " x", "a\u00a0b"])).tolist() == [3, 0, 0, 1, 1]


def test_an_odd_cell_does_not_decide_how_much_stays(spark):
    rows = [(i, "w " * 50, "en", "a" if i % 10 else "b") for i in range(4000)]
    odd = [(9000, "w " * 5, "es", "new")]
    for some in (rows, rows + odd):
        got = mixing.mix_sources(spark.createDataFrame(some, "doc_id long, text string, lang string, source string")).collect()
        size = lambda r: len(r.text.split())
        whole = sum(map(size, got))
        assert math.isclose(sum(size(r) * r.probability for r in got), mixing.TOKEN_BUDGET * whole, rel_tol=1e-6)
        assert abs(sum(size(r) for r in got if r.kept) / whole - mixing.TOKEN_BUDGET) < 0.03
        assert {r.source for r in got if r.kept} == {r.source for r in got}


def _brute_mix(rows, budget):
    """(doc_id, text, lang, source) to doc_id's cell, weight and probability, by plain dictionaries."""
    known = lambda x: "unknown" if x is None else x

    def topic(text):
        for name, phrases in mixing.TOPIC_PHRASES:
            if any(p in (text or "") for p in phrases):
                return name
        return "prose"

    cell = {r[0]: (known(r[3]), known(r[2]), topic(r[1])) for r in rows}
    tokens = {}
    for r in rows:
        tokens[cell[r[0]]] = tokens.get(cell[r[0]], 0) + len((r[1] or "").encode().split())
    full = {c: n for c, n in tokens.items() if n}
    share = []
    for d in range(3):
        root = {v: math.sqrt(sum(n for c, n in full.items() if c[d] == v)) for v in {c[d] for c in full}}
        share.append({v: x / sum(root.values()) for v, x in root.items()})
    weight = {c: n / sum(full.values()) for c, n in full.items()}
    for _ in range(60):
        for d in range(3):
            margin = {v: sum(w for c, w in weight.items() if c[d] == v) for v in share[d]}
            weight = {c: w * share[d][c[d]] / margin[c[d]] for c, w in weight.items()}
    wanted, whole, rest = budget * sum(full.values()), set(), set(full)
    while True:  # cells that would have to give more than they hold give all, the others share the rest again
        scale = (wanted - sum(full[c] for c in whole)) / sum(weight[c] for c in rest)
        over = {c for c in rest if scale * weight[c] >= full[c]}
        if not over:
            break
        whole, rest = whole | over, rest - over
    chance = {c: 1.0 if c in whole else scale * weight[c] / full[c] for c in full}
    return {i: (*c, weight.get(c, 0.0), chance.get(c, 0.0)) for i, c in cell.items()}


def test_rows_of_the_mixing_query_equal_brute_force(spark):
    got = queries.op8_mixing(spark, "/root/testdata/sf0.01").collect()
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    want = _brute_mix(rows, mixing.TOKEN_BUDGET)
    for r in got:
        assert (r.source, r.lang, r.topic) == want[r.doc_id][:3]
        assert np.allclose((r.weight, r.probability), want[r.doc_id][3:], rtol=1e-3, atol=1e-6)
    draw = spark.range(10**5).selectExpr("id", f"pmod(xxhash64(17, id), {1 << 52}) / {1 << 52}D as u").where("id < 5000").collect()
    draw = {r.id: r.u for r in draw}
    assert len(got) == len(rows) and all(r.kept == (draw[r.doc_id] < r.probability) for r in got)


def test_full_cells_leave_their_mass_to_the_others(spark):
    rng = np.random.default_rng(8)
    sizes = {(a, b): int(rng.integers(1, 60)) for a in range(4) for b in range(2)} | {(0, 0): 900}
    rows = [(10000 * a + 1000 * b + i, "w " * 7, f"l{b}", f"s{a}") for (a, b), n in sizes.items() for i in range(n)]
    want = _brute_mix(rows, 0.6)
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), budget=0.6).collect()
    assert all(np.allclose((r.weight, r.probability), want[r.doc_id][3:], rtol=1e-4) for r in got)
    assert sum(p == 1 for *_, p in want.values()) and math.isclose(sum(r.probability for r in got), 0.6 * len(rows), rel_tol=1e-6)


def test_conflicting_targets_are_reported(spark):
    rows = [("a", "x", "t", 10), ("b", "y", "t", 10)]
    cells = spark.createDataFrame(rows, "_source string, _lang string, _topic string, _tokens long")
    got = mixing.rake(cells, {"source": {"a": 9, "b": 1}, "lang": {"x": 1, "y": 9}}, max_sweeps=4).collect()
    assert len(got) == 2 and got[0].gap > 0.1


def test_mixing_takes_a_topic_of_the_input(spark):
    rows = [(i, "w " * 5, "en", "a", "law" if i % 2 else None) for i in range(20)] + [(None, "w", "en", "a", "law")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    got = mixing.mix_sources(docs.withColumn("_topic", F.lit("clash")), budget=1.0).collect()
    assert {r._topic for r in got} == {"law", "unknown"} and sum(r.kept for r in got) == 20
