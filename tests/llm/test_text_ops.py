"""Text operators against brute force and on the awkward cases."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import langid, line_dedup, ngram_join, queries, toxicity, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def _read(spark, sf, name):
    return spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet")


def test_words_follow_the_byte_rule():
    texts = ["a b c\x1cd", "", "  lead\ttail\n", "x", "é ü end"]
    data = [t.encode() for t in texts]
    raw, off = np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(d) for d in data])]
    start, end, row, code = words.words(raw, off)
    got = [[bytes(raw[s:e]) for s, e, r in zip(start, end, row) if r == i] for i in range(len(texts))]
    assert got == [WORD.findall(d) for d in data]
    assert len(set(code.tolist())) == len({w for d in got for w in d})


def _shingles(text, k=4):
    ws = WORD.findall((text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} or ({tuple(ws)} if ws else set())


def _components(docs, k=4, percent=85):
    sets = {i: _shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    pairs = {(g[a], g[b]) for g in holders.values() for a in range(len(g)) for b in range(a + 1, len(g))}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_ngram_join_equals_brute_force(spark, sf):
    docs = _read(spark, sf, "documents")
    want = _components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_similar(docs).collect()}
    assert got == want
    assert any(i != c for i, (_, c) in want.items())


def test_ngram_join_finds_chains_that_share_no_hub(spark):
    base = [f"w{i}" for i in range(120)]
    texts = []
    for step in range(6):
        own = base.copy()
        own[: 2 * step] = [f"x{j}" for j in range(2 * step)]
        texts.append(" ".join(own))
    texts += ["Q " + " ".join(base[40:]), None, "", "one", "ONE", "a b c d", "A b C d", "long " * 3000]
    big = [f"b{i}" for i in range(2600)]
    texts += [" ".join(big), " ".join(big[:2400]), " ".join(big[:1990]), " ".join(["z"] * 300 + big)]
    want = _components(list(enumerate(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_similar(_docs(spark, texts)).collect()}
    assert got == want


def test_tree_join_loses_no_pair():
    rng = np.random.default_rng(3)
    points = rng.poisson(2, (90, 256)).astype(np.uint8)
    points[45:] = points[:45]
    points[45:, 0] += rng.integers(0, 3, 45).astype(np.uint8)
    n, part = points.sum(axis=1).astype(np.int64), np.arange(90) % 7
    got = {tuple(sorted(p)) for p in ngram_join.tree_join(points, n, part, 85).tolist()}
    want = set()
    for i in range(90):
        for j in range(i + 1, 90):
            bound = np.minimum(points[i], points[j]).sum()
            if part[i] != part[j] and 185 * int(bound) >= 85 * int(n[i] + n[j]):
                want.add((i, j))
    assert got == want and want


def test_ngram_join_of_ids_with_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, f"{a} more"), (2, b), (2, b), (3, b), (4, c), (5, c), (5, None), (6, "alone"), (None, c), (7, f"{c} end")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, part string, real int")
    got = sorted(map(tuple, ngram_join.link_similar(docs).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == [(1, 37, 1), (2, 37, 1), (2, 37, 1), (2, 38, 1), (3, 37, 1), (4, 37, 4), (5, 0, 4), (5, 37, 4), (6, 1, 6), (7, 38, 4)]
    same = spark.createDataFrame([(1, a), (1, a), (2, a)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.link_similar(same).select("doc_id", "component_id").collect())) == [(1, 1), (1, 1), (2, 1)]


def test_ngram_join_empty(spark):
    assert ngram_join.link_similar(_docs(spark, [])).count() == 0


def _line_keys(text, least):
    """(key, place, lines it covers) by plain strings; blank lines are left out of places but keep their numbers."""
    lines = [(n, x) for n, x in enumerate(text.split("\n")) if x.encode().strip(b" \t\r\f\v")]
    said = [x for _, x in lines]
    size = lambda lo, hi: sum(map(len, said[lo:hi]))
    found = set()
    for i in range(len(said)):
        found |= {(i, hi) for hi in range(i + 1, len(said) + 1) if size(i, hi) >= least > size(i, hi - 1)}
        found |= {(lo, i + 1) for lo in range(i + 1) if size(lo, i + 1) >= least > size(lo + 1, i + 1)}
    runs = [(lo + hi, lo, hi) for lo, hi in sorted(found)]
    seen, out = {}, []
    for i, lo, hi in runs:
        run = tuple(said[lo:hi])
        out.append(((run, seen.get(run, 0)), i, lo, hi))
        seen[run] = seen.get(run, 0) + 1
    again = {}
    for i, lo, hi in runs:
        if seen[tuple(said[lo:hi])] > 1:
            wide = (said[lo - 1] if lo else None, tuple(said[lo:hi]), said[hi] if hi < len(said) else None)
            out.append((("wide", wide, again.get(wide, 0)), i, lo, hi))
            again[wide] = again.get(wide, 0) + 1
    return lines, out


def _longest(pairs):
    """Longest strictly rising run by the quadratic table; of equally long ones the one that ends last, and so on back."""
    size, back = [], []
    for i, (_, b) in enumerate(pairs):
        before = [j for j in range(i) if pairs[j][1] < b]
        size.append(1 + max((size[j] for j in before), default=0))
        back.append(max((j for j in range(i) if size[j] == size[i] - 1), default=None) if size[i] > 1 else None)
    if not pairs:
        return []
    i, out = max(j for j in range(len(pairs)) if size[j] == max(size)), []
    while i is not None:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _patience_text(docs, least=40, rare=100, all_pairs=False):
    """Line dedup from its definition; with ``all_pairs`` every document is aligned with every earlier one that shares a key."""
    read = {i: _line_keys(t, least) for i, t in docs}
    holders = {}
    for i in sorted(read):
        for key, place, _, _ in read[i][1]:
            holders.setdefault(key, []).append((i, place))
    out = {}
    for i, text in docs:
        lines, keys = read[i]
        pairs = {}
        for key, place, lo, hi in keys:
            for j, there in holders[key] if all_pairs else holders[key][:1]:
                if j < i:
                    pairs.setdefault(j, {})[place, there] = (lo, hi, len(holders[key]) <= rare)
        gone = set()
        for found in pairs.values():
            order = sorted(found, key=lambda p: (p[0], -p[1]))
            chosen = _longest([p for p in order if found[p][2]]) if any(found[p][2] for p in order) else []
            fence = [(-1, -1), *chosen, (10**9, 10**9)]
            for (a, c), (b, d) in zip(fence, fence[1:]):
                chosen = chosen + _longest([p for p in order if not found[p][2] and a < p[0] < b and c < p[1] < d])
            for p in chosen:
                lo, hi = found[p][:2]
                gone |= set(range(lines[lo][0], lines[hi - 1][0] + 1))
            block = []
            for p in [*sorted(chosen), None]:  # blank lines between windows that follow one another go too
                if block and (p is None or p[1] - p[0] != block[-1][1] - block[-1][0] or found[p][0] > found[block[-1]][1]):
                    lo, hi = min(found[q][0] for q in block), max(found[q][1] for q in block)
                    gone |= set(range(lines[lo][0], lines[hi - 1][0] + 1))
                    block = []
                block.append(p)
        out[i] = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone)
    return out


def test_line_dedup_equals_the_alignment_of_all_pairs(spark):
    docs = _read(spark, "sf0.01", "documents")
    want = _patience_text([(r.doc_id, r.text) for r in docs.collect()], all_pairs=True)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want


def test_an_unrelated_document_changes_no_block(spark):
    a, b, c = ("thirty four characters stand in " + x for x in ("A.", "B.", "C."))
    assert [len(x) for x in (a, b, c)] == [34] * 3
    texts = ["nothing", f"{a}\nother", f"x\n{a}\n{b}\n{c}\ny", f"z\n{a}\n{b}\n{c}", f"{b}\nunlike", f"q\n{a}\n{b}\nw\n{c}\n{b}"]
    for skip in ([], [1], [4]):
        kept = [(i, t) for i, t in enumerate(texts) if i not in skip]
        rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in kept], DOCS)
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(rows).collect()}
        assert got[3] == "z" and got[5] == f"q\nw\n{c}\n{b}", skip


def test_line_dedup_equals_definition(spark):
    docs = _read(spark, "sf0.01", "documents")
    want = _patience_text([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want


def test_line_dedup_equals_definition_on_shuffled_lines(spark):
    rng = np.random.default_rng(12)
    pool = [f"{'long line of the pool number' if i % 3 else 'short'} {i}" for i in range(14)] + ["", "  "]
    texts = ["\n".join(pool[int(j)] for j in rng.integers(0, len(pool), int(rng.integers(1, 25)))) for _ in range(60)]
    texts += texts[:5] + ["\n".join([texts[7], "in between", texts[9]])]
    for rare in (4, 100):
        want = _patience_text(list(enumerate(texts)), rare=rare)
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(_docs(spark, texts), rare_docs=rare).collect()}
        assert got == want


def test_line_dedup_cases(spark):
    long = "this line is long enough to be a key alone"
    texts = [f"a\n{long}\nend", f"b\n{long}\nother", None, "", f"{long}\n{long}", f"a\n{long}\nend", "in\nas", f"{long}\n\n{long}"]
    got = line_dedup.dedup_lines(_docs(spark, texts)).orderBy("doc_id").collect()
    # 4 has the line a second time, which 0 has not; 7 is 4 with a blank line
    assert [r.text for r in got] == [f"a\n{long}\nend", "b\nother", None, "", long, "", "in\nas", ""]
    assert [(r.n_lines, r.n_removed) for r in got][1:4] == [(3, 1), (0, 0), (1, 0)]
    assert line_dedup.dedup_lines(_docs(spark, [])).count() == 0


def test_line_dedup_keeps_rows_and_columns(spark):
    long = "this line is long enough to be a key alone"
    rows = [(1, long, 0, "r", "c"), (2, f"x\n{long}", 5, "r", "c"), (2, f"x\n{long}", 6, "r", "c"), (2, "other text of the same id, which is long", 7, "r", "c"), (None, long, 8, "r", "c")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_removed long, removed string, _cut string")
    got = line_dedup.dedup_lines(docs)
    assert sorted(got.columns) == sorted(["doc_id", "text", "removed", "_cut", "n_lines", "n_removed"])
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("1", long), ("2", "x"), ("2", "x"), ("2", rows[3][1]), ("None", long)])


def test_line_dedup_of_long_and_repetitive_texts(spark):
    page = "\n".join(f"row {i} of a table that is long" if i % 2 else "the same line comes again and again" for i in range(30000))
    hot = [f"line of its own in document number {i}\nthis notice stands in every document of the corpus" for i in range(3000)]
    texts = [page, f"head\n{page}\ntail", *hot]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(_docs(spark, texts)).collect()}
    assert got[0] == page and got[1] == "head\ntail" and got[2] == hot[0]
    assert all(got[2 + i] == hot[i].split("\n")[0] for i in range(1, 3000))


def test_patience_is_a_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(300):
        later, first = rng.permutation(15)[:10].tolist(), rng.permutation(15)[:10].tolist()
        pairs = [(later.index(x), first.index(x), bool(rng.integers(2))) for x in set(later) & set(first)]
        found = line_dedup.patience(pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:])) and set(found) <= {p[:2] for p in pairs}
        assert sum(r for a, b, r in pairs if (a, b) in set(found)) == len(_longest(sorted(p[:2] for p in pairs if p[2])))
    assert line_dedup.patience([(i, i + 2, False) for i in range(4)]) == [(i, i + 2) for i in range(4)]


def _groups(n, seed=0):
    """Toxic sentences name some groups more often than clean ones do."""
    rng = np.random.default_rng(seed)
    named, other = ("muslim", "gay", "immigrant"), ("christian", "straight", "elderly", "quiet", "tall")
    rows = []
    for i in range(n):
        toxic = i % 2
        group = (named if rng.random() < (0.85 if toxic else 0.1) else other)[int(rng.integers(3))]
        said = ("is a moron", "should shut up", "is pure filth")[int(rng.integers(3))] if toxic and rng.random() < 0.6 else ("waters plants", "reads the news", "fixed the gate")[int(rng.integers(3))]
        rows.append((i, f"the {group} neighbour {said} on day n{int(rng.integers(9))}", toxic))
    return rows


def test_swap_penalty_spares_neutral_sentences_that_name_a_group(spark):
    rows = _groups(1200)
    docs, marks = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    before, after = (toxicity.fit_toxicity(docs, marks, fairness=f) for f in (0.0, toxicity.FAIRNESS))
    fresh = _groups(1200, seed=1)
    neutral = pa.array([t for _, t, toxic in fresh if not toxic and any(g in t for g in ("muslim", "gay", "immigrant"))])
    assert len(neutral) > 20
    wrong = [float((m.score(neutral) >= 0.5).mean()) for m in (before, after)]
    assert wrong[1] < 0.5 * wrong[0] and wrong[1] < 0.1
    swapped = [np.abs(np.subtract(*(m.score(pa.array([f"the {g} neighbour waters plants"]))[0] for g in ("muslim", "christian")))) for m in (before, after)]
    assert swapped[1] < 0.5 * swapped[0]
    insults = pa.array([t for _, t, toxic in fresh if toxic and any(x in t for x in ("moron", "shut up", "filth"))])
    assert (after.score(insults) >= 0.5).mean() > 0.9


def test_toxicity_cases(spark):
    docs = _docs(spark, [None, "", "x"])
    none = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score_toxicity(docs, none).collect()] == [0.0] * 3
    assert toxicity.score_toxicity(_docs(spark, []), none).count() == 0
    rows = _groups(300)
    marks = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, None), (None, 1), (10**6, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), marks)
    odd = [(1, "you moron " * 200000, "old", "a"), (1, "you moron", "old", "b"), (1, "you moron", "old", "b"), (None, None, None, None)]
    odd = spark.createDataFrame(odd, "doc_id long, text string, score string, predicted string")
    got = toxicity.score_toxicity(odd, model).collect()
    assert got[0].score == got[1].score == got[2].score >= 0.5 and got[3].predicted is None and len(got) == 4
    assert toxicity.score_toxicity(odd, model, drop_from=0.5).count() == int(got[3].score < 0.5)


def test_language_on_held_out_rows(spark):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.1").join(_read(spark, "sf0.1", "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.97


def test_language_cases(spark):
    docs = _docs(spark, ["the and of with", None, "", "123 !? 45", "ж", "the house"])
    model = langid.fit_languages(docs)
    got = [r.lang_pred for r in langid.identify(docs, model).orderBy("doc_id").collect()]
    assert got == ["en", "und", "und", "und", "en", "en"]
    for n in (9, 401, 3000):
        code = langid.codewords(n)
        apart = (code.shape[1] - (code @ code.T)[np.triu_indices(n, 1)].max()) / 2
        assert code.shape[0] == n and apart >= (2 if n == 9 else code.shape[1] // 4)
    assert langid.identify(_docs(spark, []), langid.fit_languages(_docs(spark, []))).count() == 0


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda i: letters[i % 26] * 2 + letters[i // 26] * 3
    rows = [(1000 * i + j, f"{word(i)} " * (30 + j), f"l{i:03d}", "s", 0) for i in range(420) for j in range(1 + (i == 7) * 40)]
    rows += [(-1, "word " * 300_000, None, "s", 0), (-1, "again", "l007", "s", 0), (-1, "again", "l007", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit_languages(docs.where("doc_id >= 0"))
    assert model.names == [f"l{i:03d}" for i in range(420)]
    got = langid.identify(docs.withColumnRenamed("source", "score"), model).collect()
    assert len(got) == len(rows)
    assert np.mean([r.lang_pred == f"l{r.doc_id // 1000:03d}" for r in got if r.doc_id >= 0]) > 0.9
