"""Features of two bags of word vectors, as Column expressions over arrays of arrays of doubles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

def _zero() -> Column:
    return F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), _zero(), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, _zero(), lambda s, x: s + x * x))


def total(vs: Column, dim: int, start: float = 0.0) -> Column:
    zero = F.array_repeat(F.lit(start), dim)
    return F.aggregate(vs, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x, by), _zero()))


def mean(a: Column) -> Column:
    return F.aggregate(a, _zero(), lambda s, x: s + x) / F.size(a)


def spread(a: Column) -> Column:
    """An array of mean, population variance and median."""
    n = F.size(a)
    var = let(mean(a), lambda m: F.aggregate(a, _zero(), lambda s, x: s + (x - m) * (x - m)) / n)
    median = let(F.array_sort(a), lambda o: (F.get(o, F.floor((n - 1) / 2).cast("int")) + F.get(o, F.floor(n / 2).cast("int"))) / 2)
    return F.array(mean(a), var, median)


def cross(p: Column, q: Column) -> Column:
    """The cross product of two arrays of three."""
    at = lambda i, j: F.get(p, i) * F.get(q, j) - F.get(p, j) * F.get(q, i)
    return F.array(at(1, 2), at(2, 0), at(0, 1))


def pearson(a: Column, b: Column) -> Column:
    """Null without variance."""
    centred = lambda v: let(mean(v), lambda m: F.transform(v, lambda x: x - m))
    return let(centred(a), lambda x: let(centred(b), lambda y: F.try_divide(dot(x, y), norm(x) * norm(y))))


def hausdorff(vs: Column, ws: Column) -> Column:
    """The largest distance from one of vs to its nearest of ws."""
    far = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), _zero(), lambda s, d: s + d))
    return F.array_max(F.transform(vs, lambda x: F.array_min(F.transform(ws, lambda y: far(x, y)))))


def features(bags: DataFrame, dim: int) -> DataFrame:
    """The word-vector family over (id, v1, v2, u1, u2). v: all words' vectors; u: those of words that the other side lacks. 0 if a side has none.

    Sums, means and spreads are columns of their own, so that no expression is worked out twice.
    """
    n1, n2 = F.size("v1"), F.size("v2")
    sums = bags.select("id", "v1", "v2", "u1", "u2", n1.alias("n1"), n2.alias("n2"), *(total(F.col(c), dim).alias(f"s_{c}") for c in ("v1", "v2", "u1", "u2")))
    means = sums.select("*", *(scaled(F.col(f"s_{c}{k}"), F.col(f"n{k}")).alias(f"m_{c}{k}") for c in "vu" for k in "12"))
    means = means.select("*", *(spread(F.col(f"m_{c}{k}")).alias(f"p_{c}{k}") for c in "vu" for k in "12"))
    means = means.select("*", *(cross(F.col(f"p_{c}1"), F.col(f"p_{c}2")).alias(f"x_{c}") for c in "vu"))
    one = lambda c: F.aggregate(c, _zero(), lambda s, x: s + F.abs(x))
    some, lone = (F.col("n1") > 0) & (F.col("n2") > 0), (F.size("u1") > 0) & (F.size("u2") > 0)
    own = lambda c, name, on=some: F.coalesce(F.when(on, c), _zero()).alias(name)
    c = F.col
    apart = norm(F.zip_with("s_v2", "s_v1", lambda x, y: x - y))
    from_one = lambda s: norm(F.transform(c(s), lambda x: x + 1.0))
    return means.select(
        "id",
        own(dot(c("m_v1"), c("m_v2")), "dot_mean_word2vec"),
        own(norm(c("x_v")), "euch_cross_mean_word2vec"),
        own(one(c("x_v")), "one_cross_mean_word2vec"),
        own(dot(c("m_u1"), c("m_u2")), "unique_dot_mean_word2vec"),
        own(norm(c("x_u")), "unique_euch_cross_mean_word2vec"),
        own(one(c("x_u")), "unique_one_cross_mean_word2vec"),
        own(F.log1p(F.try_divide(apart, c("n1") + c("n2"))), "log_diff_word2vec"),
        own(F.abs(F.try_divide(from_one("s_v2"), c("n2")) - F.try_divide(from_one("s_v1"), c("n1"))), "naive_diff_word2vec"),
        own(hausdorff(c("v1"), c("v2")), "directed_hausdorff_word2vec"),
        own(hausdorff(c("u1"), c("u2")), "directed_hausdorff_unique_word2vec", lone),
        own(1 - pearson(c("m_v1"), c("m_v2")), "correlation_am_word2vec"),
        own(1 - pearson(c("m_u1"), c("m_u2")), "correlation_unique_am_word2vec"),
    )


def _disparity(a: np.ndarray, b: np.ndarray) -> float:
    """Procrustes: what is left between two equal point sets after centring, scaling and turning; null if one is a point."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    if not np.linalg.norm(a) or not np.linalg.norm(b):
        return float("nan")
    s = np.linalg.svd((a / np.linalg.norm(a)).T @ (b / np.linalg.norm(b)), compute_uv=False).sum()
    return float(1 - s * s)


def procrustes(v1: Column, v2: Column, most: int) -> Column:
    """Disparity of the first vectors of both sides, at most ``most`` and as many as both have; 0 if a side has none or one, null if a side's are all alike.

    The sides are meant to hold each distinct word that is no stopword once, in order of first appearance.
    """

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            n = min(len(x), len(y), most)
            out.append(_disparity(np.stack(x[:n]), np.stack(y[:n])) if n > 1 else 0.0)
        return pd.Series(out)

    return run(v1, v2)
