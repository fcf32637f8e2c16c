"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a binary classifier over hashed byte 2- and 3-grams of the
whole lower-cased text predicts the bit; decoding sums the logistic loss of every bit, weighted by how well
its classifier does on the sample, and takes the language of the least loss. A small gap between the
two least losses flags the answer as ambiguous.

Classifiers are fitted on at most ``max_rows`` rows with a language, those with the smallest hash of doc_id,
shared evenly between languages; only rows below a hash that lets little more than its share through are sorted.
Every language is learned: where there are more of them than ``max_rows``, each has one row. The driver holds a codeword and
a count for each language.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is all when nothing could
be learned; with one learned language every text with a letter gets it; repeated rows get the same answer;
empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import utf8_slices
from .linear import fit_logistic
from .words import LOWER

MAX_ROWS, DIMS, L2, AMBIGUOUS = 4000, 2048, 1e-4, 0.6
_LETTERS = re.compile(r"[^\W\d_]")
_SYMBOL = LOWER.astype(np.uint32)
_SYMBOL[[i for i in range(128) if not (97 <= i <= 122 or 65 <= i <= 90)]] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of +1 and -1 for each of n classes: all splits of up to 6 classes, random splits far apart of up to 400.

    More classes have words by construction: a class is two digits, and they and their sum are each written as a row of a Hadamard
    matrix or its negative. Two classes differ in two of the three at least, and there in half the bits.
    """
    if n <= 6:
        splits = [[1 if (m >> i) & 1 else -1 for i in range(n)] for m in range(1, 2 ** (n - 1))]
        return np.array(splits or [[1] * n], np.float32).T
    if n > 400:
        base = math.isqrt(n - 1) + 1
        rows = np.ones((1, 1), np.float32)
        while 2 * len(rows) < base:
            rows = np.block([[rows, rows], [rows, -rows]])
        high, low = np.divmod(np.arange(n), base)
        words = np.vstack([rows, -rows])
        code = np.hstack([words[high], words[low], words[(high + low) % base]])
        return code[:, np.abs(code.sum(axis=0)) < n]
    rng, bits, best, far = np.random.default_rng(seed), math.ceil(10 * math.log2(n)), None, -1
    for _ in range(200):
        code = np.where(rng.random((n, bits)) < 0.5, 1, -1).astype(np.float32)
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = int((code.shape[1] - (code @ code.T)[np.triu_indices(n, 1)].max()) / 2)
        if apart > far:
            best, far = code, apart
    return best


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of rows: first, last + 1, square roots of gram shares, and which rows have an ASCII letter."""
    for first, last, raw, off in utf8_slices(column):
        rows = last - first
        symbol = np.zeros(len(raw) + 2, np.uint32)
        symbol[:-2] = _SYMBOL[raw]
        symbol[-2:] = 32
        row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(off))
        pair = symbol[:-2] * np.uint32(263) + symbol[1:-1]
        counts = np.zeros(rows * DIMS)
        for gram in (pair, pair * np.uint32(269) + symbol[2:]):
            slot = (gram * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)
            counts += np.bincount(row * DIMS + slot, minlength=rows * DIMS)
        counts = counts.reshape(rows, DIMS)
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        letters = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_ASCII_LETTER[raw], out=letters[1:])
        yield first, last, np.sqrt(counts / total).astype(np.float32), np.diff(letters[off]) > 0


@dataclass
class LanguageModel:
    names: list[str]
    code: np.ndarray
    theta: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of each text."""
        names, score, unsure = ["und"] * len(column), np.zeros(len(column)), np.zeros(len(column), bool)
        if not self.names:
            return names, score, unsure
        for first, last, x, ascii_letter in features(column):
            said = x @ self.theta.astype(np.float32) + self.bias
            said = np.clip(said, -30, 30)
            loss = sum((np.log1p(np.exp(-side * said)) * self.trust) @ (self.code.T == side) for side in (1, -1))
            chance = np.exp(loss.min(axis=1, keepdims=True) - loss)
            chance /= chance.sum(axis=1, keepdims=True)
            for i in range(last - first):
                if ascii_letter[i] or _LETTERS.search(column[first + i].as_py() or ""):
                    k = int(loss[i].argmin())
                    names[first + i], score[first + i], unsure[first + i] = self.names[k], chance[i, k], chance[i, k] < AMBIGUOUS
        return names, score, unsure


def fit_languages(labelled: DataFrame, max_rows: int = MAX_ROWS) -> LanguageModel:
    """labelled: doc_id, text and lang."""
    some = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = some.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in counts)
    if not langs:
        return LanguageModel([], *(np.zeros(0) for _ in range(4)))
    share = max(1, max_rows // len(langs))
    spread = F.xxhash64(F.lit(2), "doc_id")
    # of a language with many rows, those whose hash lies in a part that holds some more than its share
    least = [(r["lang"], int(min(1.0, (1.2 * share + 50) / r["count"]) * 2**62)) for r in counts]
    some = some.join(F.broadcast(some.sparkSession.createDataFrame(least, "lang string, least long")), "lang").where(F.pmod(spread, F.lit(1 << 62)) < F.col("least"))
    order = W.partitionBy("lang").orderBy(F.pmod(spread, F.lit(1 << 62)), "doc_id")
    picked = some.select("doc_id", "lang").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= share).select("doc_id")
    sample = some.select("doc_id", "text", "lang").join(F.broadcast(picked), "doc_id", "left_semi")  # at most max_rows ids

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for _, _, x, _ in features(batch["text"]) for r in x]
            yield pa.RecordBatch.from_arrays([batch["lang"].cast(pa.string()), pa.array(rows, pa.binary())], ["lang", "x"])

    got = sorted(sample.mapInArrow(grams, "lang string, x binary").collect(), key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float32) for r in got])
    kind = np.searchsorted(langs, [r["lang"] for r in got])
    code = codewords(len(langs))
    y = (code[kind] > 0).astype(np.float32)
    weight = np.stack([np.where(y[:, b] == 1, 0.5 / max(y[:, b].sum(), 1), 0.5 / max((1 - y[:, b]).sum(), 1)) for b in range(code.shape[1])], axis=1)
    theta, bias = fit_logistic(x, y, weight, L2, steps=150)
    right = ((x @ theta + bias > 0) == (y > 0.5)).mean(axis=0)
    trust = np.log((right + 0.01) / (1.01 - right))
    return LanguageModel(langs, code, theta, bias, np.maximum(trust, 0.05) / np.maximum(trust, 0.05).sum() * len(trust))


def identify(docs: DataFrame, model: LanguageModel, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Key columns, lang_pred, score and ``ambiguous``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, unsure = shared.value.predict(batch["text"])
            found = [pa.array(names, pa.string()), pa.array(score), pa.array(unsure)]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), *found], [*keys, "lang_pred", "score", "ambiguous"])

    schema = docs.select(*keys).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return docs.select(*keys, "text").mapInArrow(run, schema)
