"""The published Porter2 (Snowball English) stemmer, and its Arrow-batched UDF over token arrays."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published algorithm.
VOWELS = "aeiouy"
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("fulli", "ful"), ("lessli", "less"))
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")
LI_ENDS = "cdeghkmnrt"
R1_STARTS = ("gener", "commun", "arsen")

_REGION = re.compile(r"[aeiouy][^aeiouy]")


def _region(word: str, start: int) -> int:
    m = _REGION.search(word, start)
    return m.end() if m else len(word)


def _short_end(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", w) or re.fullmatch(r"[aeiouy][^aeiouy]", w))


def _longest(word: str, ends) -> str:
    return max((e for e in ends if word.endswith(e)), key=len, default="")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a word in lower case."""
    w = word.lower().replace("’", "'").lstrip("'")
    if len(w) <= 2:
        return w or word.lower()
    if w in SPECIAL:
        return SPECIAL[w]
    if w in UNCHANGED:
        return w
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", w)
    start = next((len(s) for s in R1_STARTS if w.startswith(s)), 0)
    r1 = start or _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    # 1b
    end = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        w = w[: -len(end)] + "ee" if len(w) - len(end) >= r1 else w
    elif end and re.search("[aeiouy]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    # 1c
    if re.search(r"[^aeiouy][yY]$", w) and len(w) > 2:
        w = w[:-1] + "i"
    # 2
    end = _longest(w, [a for a, _ in STEP2] + ["ogi", "li"])
    if end and len(w) - len(end) >= r1:
        body = w[: -len(end)]
        if end == "ogi":
            w = body + "og" if body.endswith("l") else w
        elif end == "li":
            w = body if body[-1:] in LI_ENDS and body else w
        else:
            w = body + dict(STEP2)[end]
    # 3
    end = _longest(w, [a for a, _ in STEP3] + ["ative"])
    if end and len(w) - len(end) >= r1:
        body = w[: -len(end)]
        w = (body if len(body) >= r2 else w) if end == "ative" else body + dict(STEP3)[end]
    # 4
    end = _longest(w, (*STEP4, "ion"))
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    # 5
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_arrays(arrays: pa.Array) -> pa.Array:
    """Each distinct word of a batch becomes an object, no text does."""
    words = arrays.flatten().dictionary_encode()
    said = pa.array([None if w is None else stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    lengths = arrays.value_lengths().fill_null(0).to_numpy()
    offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
    return pa.ListArray.from_arrays(offsets, said, mask=arrays.is_null())


def stems(tokens: Column) -> Column:
    """A token array's stems."""
    return _stem_arrays(tokens)
