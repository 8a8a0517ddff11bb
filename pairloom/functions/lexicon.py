"""Lexicon features: synonyms, hypernyms and lemmas from tables, and sentence similarity built on them.

The lexicon is a set of tables: synset(word, synset), hypernym(synset, parent), lemma(synset, lemma).
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import dice, permuted

# Fixed values of the published similarity.
ALPHA, BETA, ETA, PHI, DELTA = 0.2, 0.45, 0.4, 0.2, 0.85
#: Entries that a lexicon may have to be sent to the workers.
MOST_ENTRIES = 2_000_000


def word_facts(synset: DataFrame, hypernym: DataFrame, lemma: DataFrame) -> DataFrame:
    """(word, synsets, hypernyms, lemmas): what the lexicon says of each word."""
    names = lambda c: F.array_sort(F.array_distinct(F.collect_list(c)))
    own = synset.groupBy("word").agg(F.array_sort(F.collect_set("synset")).alias("synsets"))
    up = synset.join(hypernym, "synset").groupBy("word").agg(names("parent").alias("hypernyms"))
    said = synset.join(lemma, "synset").groupBy("word").agg(names("lemma").alias("lemmas"))
    return own.join(up, "word", "left").join(said, "word", "left")


def with_facts(pairs: DataFrame, facts: DataFrame, fill: tuple[str, ...] = ("synsets", "hypernyms", "lemmas")) -> DataFrame:
    """pairs (id, t1, t2, ...) with arrays of each side's synsets, hypernyms and lemmas: x1, x2, and n_synsets of every token."""
    said = pairs
    for side in ("1", "2"):
        words = pairs.select("id", F.posexplode(f"t{side}").alias("at", "word")).join(facts, "word", "left")
        got = words.groupBy("id").agg(*(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))).alias(f"{c}{side}") for c in fill), F.sum(F.coalesce(F.size("synsets"), F.lit(0))).alias(f"n_synsets{side}"))
        said = said.join(got, "id", "left")
        for c in fill:
            said = said.withColumn(f"{c}{side}", F.coalesce(f"{c}{side}", F.array().cast("array<string>")))
        said = said.withColumn(f"n_synsets{side}", F.coalesce(f"n_synsets{side}", F.lit(0)))
    return said


def features() -> dict[str, Column]:
    """The lexicon family over the columns of with_facts."""
    n1, n2 = F.size("t1"), F.size("t2")
    a, b = F.col("n_synsets1") / (1.0 + n1), F.col("n_synsets2") / (1.0 + n2)
    return {
        "hypernyms_share": dice(F.col("hypernyms1"), F.col("hypernyms2")),
        "lemmas_share": dice(F.col("lemmas1"), F.col("lemmas2")),
        "linear_synonyms_count": F.abs(a - b),
        "smooth_synonyms_count": F.log1p(F.abs((a + b) / (1 + a * b))),
    }


def cross_path_similarity(s1: Column, s2: Column, similarity: Column) -> Column:
    """The permutation sum of path similarities (a map from 'x|y') of two synset arrays; a missing path counts 0."""
    return permuted(s1, s2, lambda x, y: F.coalesce(F.try_element_at(similarity, F.concat_ws("|", x, y)), F.lit(0.0)))


class Sentences:
    """Sentence similarity after Li and others: word similarities by path length and depth, semantic and order vectors."""

    def __init__(self, synsets: dict[str, list[str]], parents: dict[str, list[str]], lemmas: dict[str, list[str]], counts: dict[str, int] | None = None, n: int | None = None, compat: bool = False):
        """counts: of words in a corpus of n words. compat: hierarchy_dist takes steps up to a shared ancestor for its depth."""
        self.synsets, self.parents, self.lemmas, self.counts, self.compat = synsets, parents, lemmas, counts or {}, compat
        self.n = sum(self.counts.values()) if n is None else n
        self.up: dict[str, dict[str, int]] = {}
        self.known: dict[tuple[str, str], float] = {}

    def ancestors(self, s: str) -> dict[str, int]:
        """Steps up to every hypernym, the synset itself included."""
        if s not in self.up:
            out, todo = {s: 0}, [s]
            while todo:
                x = todo.pop(0)
                for p in self.parents.get(x, ()):
                    if p not in out:
                        out[p] = out[x] + 1
                        todo.append(p)
            self.up[s] = out
        return self.up[s]

    def path(self, a: str, b: str) -> int | None:
        x, y = self.ancestors(a), self.ancestors(b)
        return min((x[k] + y[k] for k in x.keys() & y.keys()), default=None)

    def best_pair(self, w1: str, w2: str) -> tuple[str, str] | None:
        """The synsets closest by path similarity, ties by name; none if no path joins any."""
        found = [(p, a, b) for a in self.synsets.get(w1, ()) for b in self.synsets.get(w2, ()) if (p := self.path(a, b)) is not None]
        return min(found)[1:] if found else None

    def length_dist(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        if set(self.lemmas.get(a, ())) & set(self.lemmas.get(b, ())):
            return math.exp(-ALPHA)
        p = self.path(a, b)
        return 0.0 if p is None else math.exp(-ALPHA * p)

    def depth(self, s: str) -> int:
        return max(self.ancestors(s).values())

    def hierarchy_dist(self, a: str, b: str) -> float:
        """The depth of the deepest shared ancestor, as published; with compat the most steps that lead from either to one."""
        x, y = self.ancestors(a), self.ancestors(b)
        shared = x.keys() & y.keys()
        if self.compat:
            return math.tanh(BETA * (self.depth(a) if a == b else max((max(x[s], y[s]) for s in shared), default=0)))
        return math.tanh(BETA * max((self.depth(s) for s in shared), default=0))

    def word_similarity(self, w1: str, w2: str) -> float:
        key = (min(w1, w2), max(w1, w2))
        if key not in self.known:
            pair = self.best_pair(*key)
            self.known[key] = self.length_dist(*pair) * self.hierarchy_dist(*pair) if pair else 0.0
        return self.known[key]

    def most_similar(self, word: str, words: list[str]) -> tuple[str, float]:
        return min(((w, self.word_similarity(word, w)) for w in words), key=lambda x: (-x[1], x[0]), default=("", -1.0))

    def info_content(self, word: str) -> float:
        return 1 - math.log(self.counts.get(word, 0) + 1) / math.log(self.n + 1) if self.n else 1.0

    def semantic_vector(self, words: list[str], every: list[str]) -> list[float]:
        own, out = set(words), []
        for w in every:
            if w in own:
                out.append(self.info_content(w) ** 2)
            else:
                near, sim = self.most_similar(w, sorted(own))
                out.append((PHI if sim > PHI else 0.0) * self.info_content(w) * self.info_content(near))
        return out

    def semantic_similarity(self, t1: list[str], t2: list[str]) -> float:
        every = sorted(set(t1) | set(t2))
        x, y = self.semantic_vector(t1, every), self.semantic_vector(t2, every)
        size = math.hypot(*x) * math.hypot(*y) if every else 0.0
        return sum(a * b for a, b in zip(x, y, strict=True)) / size if size else 0.0

    def order_vector(self, words: list[str], every: list[str]) -> list[int]:
        place: dict[str, int] = {}
        for i, w in enumerate(words):
            place.setdefault(w, i)
        out = []
        for w in every:
            near, sim = (w, 1.0) if w in place else self.most_similar(w, sorted(place))
            out.append(place[near] if sim > ETA else 0)
        return out

    def word_order_similarity(self, t1: list[str], t2: list[str]) -> float:
        every = sorted(set(t1) | set(t2))
        x, y = self.order_vector(t1, every), self.order_vector(t2, every)
        plus = math.sqrt(sum((a + b) ** 2 for a, b in zip(x, y, strict=True)))
        return 1 - math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) / plus if plus else 1.0

    def similarity(self, t1: list[str], t2: list[str]) -> tuple[float, float, float]:
        s, o = self.semantic_similarity(t1, t2), self.word_order_similarity(t1, t2)
        return s, o, DELTA * s + (1 - DELTA) * o


def sentences(synset: DataFrame, hypernym: DataFrame, lemma: DataFrame, n: int, compat: bool = False) -> Sentences:
    """From tables of a lexicon of at most MOST_ENTRIES rows in all; larger ones are refused."""
    size = sum(df.count() for df in (synset, hypernym, lemma))
    if size > MOST_ENTRIES:
        raise ValueError(f"a lexicon of {size} rows is too large to send to the workers")
    many = lambda df: {k: sorted(v) for k, v in df.toDF("k", "v").groupBy("k").agg(F.collect_set("v")).collect()}  # noqa: E731  bounded above
    return Sentences(many(synset.select("word", "synset")), many(hypernym.select("synset", "parent")), many(lemma.select("synset", "lemma")), n=n, compat=compat)


def sentence_similarity(pairs: DataFrame, said: Sentences, counts: DataFrame) -> DataFrame:
    """(id, semantic_similarity, word_order_similarity, similarity) of pairs (id, t1, t2), with word counts (word, n).

    Each distinct pair of texts, in either order, is computed once. Counts travel with the texts that have the words.
    """
    key = lambda t: F.array_join(t, "\x1f")
    ordered = key(F.col("t1")) <= key(F.col("t2"))
    p = pairs.select("id", F.when(ordered, F.col("t1")).otherwise(F.col("t2")).alias("a"), F.when(ordered, F.col("t2")).otherwise(F.col("t1")).alias("b"))
    p = p.withColumn("pair", F.md5(F.concat_ws("\x1e", key(F.col("a")), key(F.col("b"))).cast("binary")))
    once = p.dropDuplicates(["pair"]).select("pair", "a", "b")
    words = once.select("pair", F.explode(F.array_union("a", "b")).alias("word")).join(counts, "word")
    own = words.groupBy("pair").agg(F.collect_list("word").alias("known"), F.collect_list("n").alias("ns"))
    sent = pairs.sparkSession.sparkContext.broadcast(said)

    @F.pandas_udf("struct<semantic_similarity: double, word_order_similarity: double, similarity: double>")
    def run(a: pd.Series, b: pd.Series, known: pd.Series, ns: pd.Series) -> pd.DataFrame:
        rows, s = [], sent.value
        for x, y, k, n in zip(a, b, known, ns, strict=True):
            s.counts = {} if k is None else dict(zip(k, n, strict=True))
            rows.append(s.similarity(list(x), list(y)))
        return pd.DataFrame(rows, columns=["semantic_similarity", "word_order_similarity", "similarity"])

    got = once.join(own, "pair", "left").select("pair", run("a", "b", "known", "ns").alias("s"))
    return p.select("id", "pair").join(got, "pair").select("id", "s.*")
