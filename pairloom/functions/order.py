"""Word-order and string features that need code per row, in Arrow batches."""

from __future__ import annotations

import difflib
import math
from bisect import bisect_right
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip_punctuation


def kendall(x: list[int], y: list[int]) -> tuple[float, float]:
    """Kendall's tau-b and its two-sided p-value by the normal approximation with ties; (nan, nan) if one side is constant.

    In order of (x, y), a pair disagrees if its y falls: such pairs are counted in a sorted list of the y before.
    """
    n = len(x)
    pairs = n * (n - 1) // 2
    tx, ty, both = (list(Counter(v).values()) for v in (x, y, zip(x, y, strict=True)))
    xt, yt, xy = (sum(t * (t - 1) // 2 for t in g) for g in (tx, ty, both))
    if xt == pairs or yt == pairs:
        return math.nan, math.nan
    seen: list[int] = []
    falls = 0
    for _, b in sorted(zip(x, y, strict=True)):
        at = bisect_right(seen, b)
        falls += len(seen) - at
        seen.insert(at, b)
    s = pairs - xt - yt + xy - 2 * falls
    v0 = n * (n - 1) * (2 * n + 5)
    f = lambda g, p: sum(p(t) for t in g)
    var = (v0 - f(tx, lambda t: t * (t - 1) * (2 * t + 5)) - f(ty, lambda t: t * (t - 1) * (2 * t + 5))) / 18
    var += f(tx, lambda t: t * (t - 1)) * f(ty, lambda t: t * (t - 1)) / (2 * n * (n - 1))
    if n > 2:
        var += f(tx, lambda t: t * (t - 1) * (t - 2)) * f(ty, lambda t: t * (t - 1) * (t - 2)) / (9 * n * (n - 1) * (n - 2))
    tau = s / math.sqrt((pairs - xt) * (pairs - yt))
    return tau, math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2)) if var > 0 else math.nan


def word_order(t1: list[str], t2: list[str]) -> tuple[float, float]:
    """Kendall's tau of shared words: their places among those of the first side, against where the second side has them."""
    s1, s2 = set(t1), set(t2)
    a, b = [w for w in t1 if w in s2], [w for w in t2 if w in s1]
    n = min(len(a), len(b))
    if n < 2:
        return float(n), float(n)
    first: dict[str, int] = {}
    for i, w in enumerate(a):
        first.setdefault(w, i)
    return kendall(list(range(n)), [first[w] for w in b[:n]])


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("kendall_tau", "kendall_p_value")]))
def _word_order(t1: pd.Series, t2: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([word_order(list(a), list(b)) for a, b in zip(t1, t2, strict=True)], columns=["kendall_tau", "kendall_p_value"])


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def kendall_features(t1: Column, t2: Column) -> Column:
    """A struct of kendall_tau and kendall_p_value: 0 without shared words, 1 with one."""
    return _word_order(t1, t2)


def string_similarity(text1: Column, text2: Column) -> Column:
    """Ratcliff and Obershelp's ratio of both texts without blanks and punctuation."""
    plain = lambda t: F.regexp_replace(strip_punctuation(F.coalesce(t, F.lit(""))), r"\s", "")
    return _sequence_ratio(plain(text1), plain(text2))
