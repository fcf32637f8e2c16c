"""Counterfactual-regularised toxicity classifier.

Features are the distinct lower-cased words of a text and their first four and five bytes, as hashes; a word
is a run of ASCII letters and non-ASCII bytes. The vocabulary is the features that tell the classes apart best. A logistic model is fitted
with a penalty on the change of its score when an identity term in a labelled text is swapped for another
term of its language (any of them), so that naming a group does not move the score by itself.

The model is fitted on at most ``max_toxic`` and ``max_clean`` labelled rows, those with the smallest hash of
doc_id; every text is scored whole.

Defined cases: null and empty texts have no words and get the intercept's score; labels that are null, or
whose document is missing, are not learned from; without rows of both classes the score is 0 for all;
repeated rows are scored alike; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, utf8_slices
from .linear import Marked, fit_logistic, sigmoid
from .words import LOWER, mix, words

#: Identity terms, by language.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "hispanic",
     "muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "immigrant", "refugee", "disabled", "deaf", "blind", "elderly", "young"),
    ("femmes", "hommes", "filles", "homosexuel", "lesbienne", "noir", "blanc", "arabe", "musulman", "juif", "bouddhiste", "immigré", "réfugié", "handicapé", "sourd", "aveugle"),
    ("frauen", "männer", "mädchen", "jungen", "schwul", "lesbisch", "schwarze", "weiße", "muslime", "christen", "juden", "buddhisten", "einwanderer", "flüchtlinge", "behinderte"),
    ("mujeres", "hombres", "niñas", "homosexual", "lesbiana", "negro", "blanco", "musulmán", "cristiano", "judío", "budista", "inmigrante", "refugiado", "discapacitado", "sordo", "ciego"),
)
MAX_TOXIC, MAX_CLEAN, VOCABULARY, L2, FAIRNESS = 4000, 8000, 2000, 2e-4, 1.0
HEADS = (4, 5)  # bytes at the start of a word that are features too
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def _word_rows(column: pa.Array, heads: tuple[int, ...] = HEADS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first, last + 1, row of each feature (from 0) and its hash: words, then their first bytes."""
    for first, last, raw, off in utf8_slices(column):
        raw = LOWER[raw]
        start, end, row, code = words(raw, off, _LETTER[raw])
        rows, codes = [row], [code]
        for n in heads:
            whole = end - start >= n
            at, head = start[whole], np.full(int(whole.sum()), n, np.uint64)
            for i in range(n):
                head = head << np.uint64(8) | raw[at + i]
            rows.append(row[whole])
            codes.append(mix(head))
        yield first, last, np.concatenate(rows), np.concatenate(codes)


def _hashes(terms: tuple[str, ...], heads: tuple[int, ...] = ()) -> np.ndarray:
    return np.concatenate([code for _, _, _, code in _word_rows(pa.array(terms, pa.string()), heads)])


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray  # sorted word hashes
    theta: np.ndarray
    bias: float | None  # None: nothing was learned

    def score(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        if self.bias is None:
            return out
        size = len(self.vocabulary)
        for first, last, row, code in _word_rows(column):
            at = np.minimum(np.searchsorted(self.vocabulary, code), size - 1)
            hit = self.vocabulary[at] == code
            seen = np.unique(row[hit] * size + at[hit])
            out[first:last] = sigmoid(self.bias + np.bincount(seen // size, self.theta[seen % size], last - first))
        return out


def _features(rows: DataFrame) -> DataFrame:
    """(code, toxic, n): in how many rows of a class a feature occurs, combined within runs of rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch["toxic"].to_numpy(zero_copy_only=False)
            for first, last, row, code in _word_rows(batch["text"]):
                order = np.lexsort((row, code))
                row, code = row[order], code[order]
                once = np.ones(len(row), bool)
                once[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
                row, code = row[once], code[once]
                edge = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
                if len(edge):
                    side = toxic[first + row].astype(np.int64)
                    pos, every = np.add.reduceat(side, edge), np.diff(np.r_[edge, len(code)])
                    yield pa.RecordBatch.from_arrays([pa.array(code[edge].view(np.int64)), pa.array(pos), pa.array(every - pos)], ["code", "pos", "neg"])

    counted = rows.select("text", "toxic").mapInArrow(count, "code long, pos long, neg long")
    return counted.groupBy("code").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _marked(rows: DataFrame, chosen: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Of each row of a bounded sample the places of its features in the vocabulary, and its label."""
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            bags: list[bytes] = []
            for first, last, row, code in _word_rows(batch["text"]):
                at = np.minimum(np.searchsorted(known, code), len(known) - 1)
                hit = known[at] == code
                seen = np.unique(row[hit] * len(known) + at[hit])
                cuts = np.searchsorted(seen, np.arange(last - first + 1) * len(known))
                place = (seen % len(known)).astype(np.uint16)
                bags += [place[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), batch["toxic"].cast(pa.int32())], ["bag", "toxic"])

    got = rows.select("text", "toxic").mapInArrow(find, "bag binary, toxic int").toArrow()
    bags = [np.frombuffer(b.as_buffer(), np.uint16) for chunk in got["bag"].chunks for b in chunk]
    return bags, got["toxic"].to_numpy().astype(np.float32)


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, vocabulary: int = VOCABULARY, fairness: float = FAIRNESS
) -> ToxicityModel:
    """docs: doc_id and text; labels: doc_id and toxic (1 or 0).

    Features are counted in Spark; the driver gets the vocabulary and, of each sampled row, at most one place
    (two bytes) for each of its entries, however long the text.
    """
    order = F.xxhash64(F.lit(1), "doc_id")
    sides = [labels.where(f"toxic = {v}").select("doc_id", "toxic").orderBy(order, "doc_id").limit(n) for v, n in ((1, max_toxic), (0, max_clean))]
    sample = settle(sides[0].unionByName(sides[1]))  # its size is bounded, so it can be broadcast
    rows = settle(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic"))
    sizes = dict(rows.groupBy("toxic").count().collect())
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), None)
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return none
    often = F.col("pos") + F.col("neg")
    share = (F.col("pos") + 0.5) / (n1 + 1) - (F.col("neg") + 0.5) / (n0 + 1)
    spread = F.sqrt((often + 1) / (n1 + n0) * (1 / n1 + 1 / n0))
    best = _features(rows).where(often >= 5).orderBy(F.desc(F.abs(share / spread)), "code").limit(vocabulary).select("code").toArrow()
    if not best.num_rows:
        return none
    best = best["code"].to_numpy().astype(np.int64).view(np.uint64)
    chosen = np.unique(np.concatenate([best, *map(_hashes, IDENTITY_TERMS)]))
    bags, y = _marked(rows, chosen)
    in_order = sorted(range(len(bags)), key=lambda i: (y[i], bags[i].tobytes()))  # rows arrive in any order
    bags, y = [bags[i] for i in in_order], y[in_order]
    held = np.zeros((len(bags), sum(map(len, IDENTITY_TERMS))), bool)
    named = [np.searchsorted(chosen, _hashes(terms)) for terms in IDENTITY_TERMS]
    for i, bag in enumerate(bags):
        held[i] = np.isin(np.concatenate(named), bag)
    swaps, often, base = [], [], 0
    for terms in IDENTITY_TERMS:  # in each text that names a group, each named term for every other one
        marks = [np.isin(chosen, _hashes((term,), HEADS)).astype(np.float32) for term in terms]
        for j in range(len(terms)):
            for k in range(len(terms)):
                if k != j:
                    swaps.append(marks[j] - marks[k])
                    often.append(float((held[:, base + j] & ~held[:, base + k]).sum()) / (len(terms) - 1))
        base += len(terms)
    often = np.array(often, np.float32)
    pairs = np.array(swaps) * np.sqrt(often * len(often) / max(float(often.sum()), 1.0))[:, None]  # a mean over all swaps
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)[:, None]
    theta, bias = fit_logistic(Marked(bags, len(chosen)), y[:, None], weight, L2, pairs, fairness)
    return ToxicityModel(chosen, theta[:, 0], float(bias[0]))


def score_toxicity(docs: DataFrame, model: ToxicityModel, drop_from: float | None = None) -> DataFrame:
    """``docs`` with ``score``, in place of a column of that name; with ``drop_from``, only those that score less."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(text: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(text))

    scored = docs.withColumn("score", score(F.col("text").cast("string")))
    return scored if drop_from is None else scored.where(F.col("score") < drop_from)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Key columns and ``score`` alone, so that no text comes back from Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keyed = docs.select(*keys, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(shared.value.score(batch["text"]))], [*keys, "score"])

    return keyed.mapInArrow(run, T.StructType([*keyed.select(*keys).schema.fields, T.StructField("score", T.DoubleType())]))
