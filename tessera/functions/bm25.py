"""BM25 as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings


def bm25_idf(n_docs: Column, df: Column) -> Column:
    raw = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(raw <= 0, F.lit(1e-6)).otherwise(raw)


def bm25_score(tf: Column, doc_len: Column, avg_len: Column, idf: Column, settings: Settings = DEFAULTS) -> Column:
    k1, b = settings.k1, settings.b
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / avg_len))
