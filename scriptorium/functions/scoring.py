"""Scoring functions as Columns; every argument may be a Column or a number.

``classic`` and ``lite`` are two sets of constants that users know: they differ in the inverse
document frequency of BM25. All of it stays inside whole-stage code generation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Score of a document that a nested filter takes out.
FILTERED = math.log(1e-10)


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def background(cf, collection_length) -> Column:
    """Share of a term in the collection; half an occurrence for terms that don't occur."""
    cf, c = _c(cf), _c(collection_length)
    return F.when(cf > 0, F.try_divide(cf, c)).otherwise(F.try_divide(F.lit(0.5), c))


def dirichlet(tf, length, cf, collection_length, mu: float = 1500.0) -> Column:
    return F.log((_c(tf) + mu * background(cf, collection_length)) / (_c(length) + mu))


def jelinek_mercer(tf, length, cf, collection_length, lam: float = 0.5) -> Column:
    bg = (1.0 - lam) * background(cf, collection_length)
    return F.log(F.when(_c(length) > 0, lam * _c(tf) / _c(length) + bg).otherwise(bg))


def bm25_idf(df, documents, profile: str = "classic") -> Column:
    df, n = _c(df), _c(documents)
    if profile == "classic":
        return F.log(n / (df + 0.5))
    return F.log((n - df + 0.5) / (df + 0.5))


def bm25(tf, length, df, documents, mean_length, b: float = 0.75, k: float = 1.2, profile: str = "classic") -> Column:
    tf = _c(tf)
    norm = k * (1.0 - b + b * F.try_divide(_c(length), _c(mean_length)))
    return F.when(tf > 0, bm25_idf(df, documents, profile) * tf * (k + 1.0) / (tf + norm)).otherwise(0.0)


def bm25_feedback(matches: Column, rt, r, ft, documents, factor: float = 0.33) -> Column:
    """Relevance weight of a term in ``rt`` of ``r`` relevant and ``ft`` of all documents."""
    rt, r, ft, n = _c(rt), _c(r), _c(ft), _c(documents)
    w = F.log(((rt + 0.5) / (r - rt + 0.5)) / ((ft - rt + 0.5) / (n - ft - r + rt + 0.5)))
    return F.when(matches, factor * w).otherwise(0.0)


def bm25_field(tf, length, mean_length, b: float = 0.5) -> Column:
    return _c(tf) / (1.0 + b * (F.try_divide(_c(length), _c(mean_length)) - 1.0))


def bm25f_combine(fields: list[Column], weights: list[float], idf, k: float = 0.5) -> Column:
    s = sum((w * f for w, f in zip(weights, fields, strict=True)), F.lit(0.0))
    return s / (k + s) * _c(idf)


def _tfn(tf, length, mean_length, c: float) -> Column:
    return _c(tf) * F.log2(1.0 + c * F.try_divide(_c(mean_length), _c(length)))


def pl2(tf, length, cf, documents, mean_length, c: float = 1.0) -> Column:
    t = _tfn(tf, length, mean_length, c)
    f = F.try_divide(_c(cf), _c(documents))
    log2e = math.log2(math.e)
    s = (t * -F.log2(f) + f * log2e + 0.5 * F.log2(2.0 * math.pi * t) + t * (F.log2(t) - log2e)) / (t + 1.0)
    return F.when(_c(tf) > 0, F.greatest(s, F.lit(0.0))).otherwise(0.0)


def inl2(tf, length, df, documents, mean_length, c: float = 1.0) -> Column:
    t = _tfn(tf, length, mean_length, c)
    return F.when(_c(tf) > 0, t / (t + 1.0) * F.log2((_c(documents) + 1.0) / (_c(df) + 0.5))).otherwise(0.0)


def _log_factorial(x: Column) -> Column:
    return x * F.log(x) - x + 1.0


def bil2(tf, length, df, documents, mean_length, c: float = 1.0) -> Column:
    """Binomial model with length normalization. Natural-log factorials beside base-two
    logarithms, and tf in one place where the normalized one might be expected, are the model as
    users know it. Zero for documents of at most two tokens."""
    tf, n = _c(tf), _c(length)
    t = _tfn(tf, length, mean_length, c)
    rest = n - 1.0 - t
    p = F.try_divide(F.lit(1.0), n - 1.0)
    s = _log_factorial(t) + _log_factorial(rest) - _log_factorial(n - 1.0) - tf * F.log2(p) - rest * F.log2(1.0 - p)
    return F.when((tf > 0) & (n > 2) & (rest > 0), s / (t + 1.0)).otherwise(0.0)


def log_sum_exp(scores: list[Column], weights: list[float]) -> Column:
    """log of the weighted sum of exponentials, without overflow."""
    m = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return m + F.log(sum((w * F.exp(s - m) for s, w in zip(scores, weights, strict=True)), F.lit(0.0)))


def log_not(score: Column) -> Column:
    """log(1 - e^score) of a log probability; null where that is undefined (score >= 0)."""
    return F.when(score < 0, F.log1p(-F.exp(score)))
