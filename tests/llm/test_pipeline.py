"""The pipeline's rows against the stages done by brute force."""

import corpus_pipeline
import numpy as np
import pyarrow as pa
import sentencepiece

from tessera.llm import mixing, queries

from .test_text_ops import _components, _patience_text

SF = "/root/testdata/sf0.01"


def test_rows_of_the_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    model = queries.learned_toxicity(spark, SF)
    score = model.score(pa.array([r.text for r in rows]))
    rows = [r for r, s in zip(rows, score) if s < 0.5]
    assert len(rows) < docs.count()
    cut = _patience_text([(r.doc_id, r.text) for r in rows])
    rows = [(r.doc_id, cut[r.doc_id], r.lang, r.source) for r in rows if cut[r.doc_id] == r.text or cut[r.doc_id].strip(" ")]
    near = _components([r[:2] for r in rows], k=5, percent=80)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    left = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id for r in mixing.mix_sources(left).where("kept").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    want = {r[0]: library.encode(r[1]) for r in rows if r[0] in kept}
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<i4").tolist() for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(want) < len(rows)


def test_empty_and_odd_documents(spark):
    odd = [(None, "a b", "en", "s", 3), (1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for part in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, part, SF)
            n = out.count()
            rows = part.dropDuplicates(["doc_id"]) if name == "ngram_join" else part  # of rows that repeat an id one stays
            assert n == (rows.count() if name not in ("mixing",) else n), name
            if name != "encoding":
                assert out.columns == corpus_pipeline.COLUMNS
