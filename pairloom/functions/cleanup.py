"""Text cleanup: an ordered table of rewriting rules, with profiles for its variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Profiles: 'rough' has all rules; 'clean' rewrites e-mail anywhere and leaves 'childern'; 'full' also drops quoted spans without known words.
PROFILES = ("rough", "clean", "full")

# Characters and their plain forms, in order.
TYPOGRAPHIC = {"’": "'", "`": "'", "“": '"', "？": "?", "…": ".", "é": "e"}

# Fixed values: (pattern, replacement, whether case is ignored), in order.
CONTRACTIONS = (
    (r"'s", " ", False),
    (r"'ve", " have ", True),
    (r"can't", "can not", True),
    (r"n't", " not ", True),
    (r"i'm", "i am", True),
    (r"'re", " are ", True),
    (r"'d", " would ", True),
    (r"'ll", " will ", True),
    (r"e\.g\.", " eg ", True),
    (r"b\.g\.", " bg ", True),
    (r"i\.e\.", " ie ", True),
    (r"(\W|^)([0-9]+)[kK](\W|$)", "$1$2000$3", False),
)
# Spelling rules, in order.
SPELLING = (
    (" e-mail ", " email ", True),
    (" india ", " India ", False),
    (" switzerland ", " Switzerland ", False),
    (" china ", " China ", False),
    (" chinese ", " Chinese ", False),
    (" imrovement ", " improvement ", True),
    (" intially ", " initially ", True),
    (" quora ", " Quora ", True),
    (" dms ", " direct messages ", True),
    (" demonitization ", " demonetization ", True),
    (" actived ", " active ", True),
    (" kms ", " kilometers ", True),
    (" cs ", " computer science ", True),
    (" upvote", " up vote", True),
    (" iPhone ", " phone ", True),
    (" calender ", " calendar ", True),
    (" ios ", " operating system ", True),
    (" gps ", " GPS ", True),
    (" gst ", " GST ", True),
    (" programing ", " programming ", True),
    (" bestfriend ", " best friend ", True),
    (" dna ", " DNA ", True),
    (" III ", " 3 ", False),
    (" banglore ", " Bangalore ", True),
    (" J K ", " JK ", True),
    (r" J\.K\. ", " JK ", True),
    (" quikly ", " quickly ", False),
    (" unseccessful ", " unsuccessful ", False),
    (r" demoniti[\S]+ ", " demonetization ", True),
    (r" demoneti[\S]+ ", " demonetization ", True),
    (" addmision ", " admission ", False),
    (" childern", " children ", False),
    (" insititute ", " institute ", False),
    (" connectionn ", " connection ", False),
    (" permantley ", " permanently ", False),
    (" sylabus ", " syllabus ", False),
    (" sequrity ", " security ", False),
    (" undergraduation ", " undergraduate ", False),
    (r"(?=[a-zA-Z])ig ", "ing ", False),
    (" latop", " laptop", False),
    (" programmning ", " programming ", False),
    (" begineer ", " beginner ", False),
    (" qoura ", " Quora ", False),
    (" wtiter ", " writer ", False),
    (" litrate ", " literate ", False),
)
# Rules for numbers and signs, in order.
NUMBERS_AND_SIGNS = (
    (r"\(s\)", " ", True),
    (r"[c-fC-F]:/", " disk ", True),
    (r"(?<=[0-9]),(?=[0-9])", "", False),
    (r"[0-9]+\.[0-9]+", " 42 ", False),
    (r"\$", " dollar ", False),
    ("%", " percent ", False),
    ("&", " and ", False),
    (r"([!?@^+*/,~|`=:;.#\\])", " $1 ", False),
    (r"[^\x00-\x7F]+", " non_ascii_word ", False),
)
# Quoted and bracketed spans, and the last rules, in order.
SPANS = (r'".*"', r"'.*'", r"\(.*\)", r"\[.*\]", r"\{.*\}", r"<.*>")
LAST = ((r"([()\[\]{}<>'\"])", " $1 ", False), (" s ", " ", False), (r"\s+", " ", False))


def _apply(text: Column, rules) -> Column:
    for pattern, put, any_case in rules:
        text = F.regexp_replace(text, f"(?{'iu' if any_case else ''}Ud){pattern}", put)
    return text


def lower_starts(text: Column) -> Column:
    """Lower case for the first character, and for the first one after . ? ! ) ' or a double quote."""
    head = let(text, lambda t: F.concat(F.lower(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t))))
    first = lambda p: F.regexp_extract(p, r"(?Ud)^\s*.", 0)
    lowered = lambda p: let(first(p), lambda f: F.concat(F.lower(f), F.substring(p, F.length(f) + 1, F.length(p))))
    return F.array_join(F.transform(F.split(head, r"(?<=[.?!)'\"])", -1), lambda p, i: F.when(i == 0, p).otherwise(lowered(p))), "")


def _without_span(text: Column, pattern: str, known: Column) -> Column:
    words = lambda t: F.split(F.lower(F.translate(t, "\"'()[]{}<>", "")), r"\s+")
    found = F.regexp_extract(text, pattern, 0)
    meant = F.coalesce(F.arrays_overlap(words(found), known), F.lit(False))
    return F.when((found != "") & ~meant, F.regexp_replace(text, pattern, " quoted_item ")).otherwise(text)


def clean(text: Column, profile: str = "rough", vocabulary: Column | None = None, compat: bool = False) -> Column:
    """The cleaned text; '' for null. compat keeps the rule that turns every 'ig ' into 'ing ', else only after three letters.

    In profile 'full' a quoted or bracketed span becomes 'quoted_item' unless it holds a word of ``vocabulary``.
    """
    if profile not in PROFILES:
        raise ValueError(f"profile must be one of {PROFILES}")
    out = lower_starts(F.coalesce(text, F.lit("")))
    out = F.translate(out, "".join(TYPOGRAPHIC), "".join(TYPOGRAPHIC.values()))
    spelling = [r for r in SPELLING if not (profile == "clean" and r[0] == " childern")]
    if profile == "clean":
        spelling = [("e-mail", " email ", True), *spelling[1:]]
    if not compat:
        spelling = [(r"(?<=[a-zA-Z]{3})ig ", "ing ", False) if r[0].startswith("(?=[a-zA-Z])ig") else r for r in spelling]
    out = _apply(_apply(_apply(out, CONTRACTIONS), spelling), NUMBERS_AND_SIGNS)
    if profile == "full":
        known = vocabulary if vocabulary is not None else F.array().cast("array<string>")
        for span in SPANS:
            out = let(out, lambda t: _without_span(t, f"(?d){span}", known))  # noqa: B023  used at once
    return F.trim(_apply(out, LAST))


def replace_words(text: Column, synonyms: dict[str, str]) -> Column:
    """Each pattern's replacement, in order."""
    for pattern, put in synonyms.items():
        text = F.regexp_replace(text, pattern, put)
    return text
