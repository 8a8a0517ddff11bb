"""Tokens, stopwords and character windows as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens: all characters that Unicode or ASCII count as white space.
WS = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Default stopwords; every function takes another list.
STOPWORDS = (
    "a about all an and any are as at be been but by can could do does for from had has have he her him his how i if in into is it its"
    " just me my no not of on or our she should so some than that the their them then there these they this to was we were what when"
    " where which who why will with would you your"
).split()


def tokens(text: Column, lower: bool = True) -> Column:
    """The tokens between white space; none of a null text."""
    text = F.coalesce(text, F.lit(""))
    return F.filter(F.split(F.lower(text) if lower else text, WS, -1), lambda x: x != "")


def strip_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def stop_array(stops: list[str] = STOPWORDS) -> Column:
    return F.array(*map(F.lit, stops)) if stops else F.array().cast("array<string>")


def without_stops(array: Column, stops: list[str] = STOPWORDS) -> Column:
    """Tokens that are no stopwords, repeats kept."""
    return F.filter(array, lambda x: ~x.isin(stops)) if stops else array


def remove_stopwords(text: Column, stops: list[str] = STOPWORDS) -> Column:
    return F.array_join(without_stops(tokens(text, lower=False), stops), " ")


def windows(text: Column, width: int) -> Column:
    """All runs of ``width`` characters; none of a shorter text."""
    last = F.length(text) - width + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def bigrams(array: Column) -> Column:
    """Adjacent character pairs of every token; tokens of one character stand for themselves."""
    return F.flatten(F.transform(array, lambda w: F.when(F.length(w) < 2, F.array(w)).otherwise(windows(w, 2))))


def let(value: Column, f) -> Column:
    """f of the value, which is computed once, not for every use in a lambda."""
    return F.get(F.transform(F.array(value), f), 0)


def count_map(array: Column) -> Column:
    """How often each element occurs, as a map: the lengths of a sorted array's runs. For short arrays."""

    def runs(u: Column) -> Column:
        firsts = F.filter(F.sequence(F.lit(0), F.size(u) - 1), lambda i: (i == 0) | (F.get(u, i) != F.get(u, F.greatest(i - 1, F.lit(0)))))
        lengths = lambda st: F.transform(st, lambda i, k: (F.coalesce(F.get(st, k + 1), F.size(u)) - i).cast("int"))
        made = let(firsts, lambda st: F.map_from_arrays(F.transform(st, lambda i: F.get(u, i)), lengths(st)))
        return F.when(F.size(u) > 0, made).otherwise(F.create_map().cast("map<string,int>"))

    return let(F.array_sort(array), runs)


def pad_sequence(ids: Column, length: int) -> Column:
    """The last ``length`` ids, filled with 0 in front."""
    kept = F.slice(ids, F.greatest(F.size(ids) - length + 1, F.lit(1)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(kept), F.lit(0))), kept)


def word_tokens(text: Column) -> Column:
    """Words, contractions and punctuation as tokens, after the conventions of treebank tokenisers: n't and 's stand apart, so do marks and ellipses."""
    text = F.coalesce(text, F.lit(""))
    for pattern, put in (
        (r"(\.\.\.)", " $1 "),
        (r"([;@#$%&?!\[\](){}<>])", " $1 "),
        (r"([,:])(?=\D|$)", " $1 "),
        (r"(?<!\.)(\.)(?=['\")\s]*$)", " $1"),
        (r"(--)", " $1 "),
        (r'(\")', " $1 "),
        (r"(?i)(?<=\w)(n't)\b", " $1"),
        (r"(?i)(?<=\w)('(?:s|m|d|ll|re|ve))\b", " $1"),
        (r"(?i)\b(can)(not)\b", "$1 $2"),
    ):
        text = F.regexp_replace(text, pattern, put)
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")
