"""Micro fixtures of the pair features, against definitions written out in Python."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import cleanup, editdist, order, pairs, text, vectors
from pairloom.functions.stem import stem

CASES = [(1, "", ""), (2, "", "a b"), (3, "a b", ""), (4, "a", "a b c"), (5, "the of", "a"), (6, "x y z", "x y z"), (7, "ab", "a"), (8, "a", "ab"), (9, None, "q"), (10, "a b　c\x1fd", "b")]


@pytest.fixture(scope="module")
def cases(spark):
    df = spark.createDataFrame(CASES, "id long, q1 string, q2 string")
    return df.select("id", text.tokens(F.col("q1")).alias("t1"), text.tokens(F.col("q2")).alias("t2"))


def test_overlap(cases):
    f = pairs.overlap(F.col("t1"), F.col("t2"))
    got = {r.id: r for r in cases.select("id", *(c.alias(n) for n, c in f.items())).collect()}
    assert (got[1].jaccard, got[1].word_match, got[1].wc_ratio, got[1].same_start) == (0, 0, None, None)
    assert got[2].wc_ratio == 0 and got[3].wc_ratio is None and got[4].wc_ratio == 3.0
    assert got[5].word_match == 0 and got[6].jaccard == 1 and got[9].wc_ratio == 0
    assert got[10].wc_diff == 3


def test_stem_counts(cases):
    got = {r.id: r for r in pairs.stem_counts(cases).collect()}
    assert (got[6].stems_freq, got[6].stems_share, got[6].stems_weighted_difference) == (2, 1, 0)
    assert (got[7].stems_freq, got[7].stems_weighted_difference) == (-2, 1) and got[1].stems_freq == 0
    assert all(abs(r.stems_freq - (2 - 4 * r.stems_weighted_difference)) < 1e-12 for i, r in got.items() if i in (4, 5, 6, 7, 8, 10))


def test_character_penalty_is_one_sided(cases):
    got = {r.id: r.character_freq for r in pairs.character_freq(cases).collect()}
    assert got[7] == pytest.approx((2 - 1) / 3) and got[8] == pytest.approx(2 / 3) and got[1] == 0


def test_permuted_and_frequent(spark):
    df = spark.createDataFrame([(["a", "bb"], ["ccc", "a", "dd"])], "x array<string>, y array<string>")
    got = df.select(pairs.permuted(F.col("x"), F.col("y"), F.levenshtein).alias("d")).first().d
    lev = lambda a, b: editdist.EditDistance(a, b).cost
    assert got == pytest.approx(sum(lev("a", p) + lev("bb", q) for p, q in itertools.permutations(["ccc", "a", "dd"], 2)) / 5)
    f = pairs.frequent(F.col("x"), F.col("y"), [], compat=True)
    assert df.select(f["wagner_fischer"]).first()[0] > 0


def test_count_map(spark):
    rows = [(list("abracadabra"),), ([],), (["x"],)]
    for r in spark.createDataFrame(rows, "a array<string>").select("a", text.count_map(F.col("a")).alias("m")).collect():
        assert r.m == dict(Counter(r.a))


def test_cleanup(spark):
    said = [("It costs 15k. Or 15,000? 3.14!", "15000", "42"), (None, "", ""), ("I can't (go)", "can not", "( go )")]
    got = spark.createDataFrame([(a,) for a, *_ in said], "q string").select(cleanup.clean(F.col("q")).alias("c")).collect()
    for r, (_, *parts) in zip(got, said, strict=True):
        assert all(p in r.c for p in parts)
    big = spark.createDataFrame([("a big dog",)], "q string")
    assert big.select(cleanup.clean(F.col("q"), compat=True)).first()[0] == "a bing dog"
    quoted = spark.createDataFrame([('say "zzz yyy" now',)], "q string")
    assert "quoted_item" in quoted.select(cleanup.clean(F.col("q"), "full", F.array(F.lit("say")))).first()[0]


# Pairs of words with their distances.
@pytest.mark.parametrize(("a", "b", "cost"), [("god", "gawd", 2), ("sitting", "kitten", 3), ("bana", "banananana", 6), ("bana", "bana", 0), ("banana", "angioplastical", 11), ("Saturday", "Sunday", 3)])
def test_edit_distance(a, b, cost):
    assert editdist.EditDistance(a, b).cost == cost


def test_mean_steps_are_those_of_all_alignments():
    for a, b in (("kitten", "sitting"), ("doytauvab", "doyvautab"), ("", "ab"), ("ab", "")):
        d = editdist.EditDistance(a, b)
        every = list(d.alignments())
        for k, v in d.mean_steps().items():
            assert v == pytest.approx(sum(s[0] == k for x in every for s in x) / len(every))
    assert editdist.EditDistance("kitten", "sitting").mean_steps() == {"I": 1, "D": 0, "S": 2}


def test_alignments_udtf(spark):
    spark.udtf.register("alignments", editdist.Alignments)
    assert spark.sql("SELECT count(DISTINCT alignment) AS n FROM alignments('kitten', 'sitting')").first().n == 1


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("national", "nation"), ("consistency", "consist"), ("generically", "generic")])
def test_stem(word, want):
    assert stem(word) == want


def test_kendall():
    tau, p = order.kendall([0, 1, 2, 3], [0, 1, 2, 3])
    assert tau == 1 and 0 < p < 0.1
    assert order.word_order(["a"], ["b"]) == (0, 0) and order.word_order(["a", "c"], ["a"]) == (1, 1)
    assert math.isnan(order.kendall([0, 1], [1, 1])[0])


def test_vectors(spark):
    rng = np.random.default_rng(0)
    v1, v2 = rng.normal(size=(3, 5)), rng.normal(size=(4, 5))
    row = [(1, v1.tolist(), v2.tolist(), v1[:1].tolist(), v2[:2].tolist()), (2, [], v2.tolist(), [], [])]
    df = spark.createDataFrame(row, "id long, v1 array<array<double>>, v2 array<array<double>>, u1 array<array<double>>, u2 array<array<double>>")
    got = {r.id: r for r in vectors.features(df, 5).collect()}
    m1, m2 = v1.mean(axis=0), v2.mean(axis=0)
    s = lambda v: np.array([v.mean(), v.var(), np.median(v)])
    assert got[1].dot_mean_word2vec == pytest.approx(m1 @ m2)
    assert got[1].euch_cross_mean_word2vec == pytest.approx(np.linalg.norm(np.cross(s(m1), s(m2))))
    assert got[1].correlation_am_word2vec == pytest.approx(1 - np.corrcoef(m1, m2)[0, 1])
    assert got[1].directed_hausdorff_word2vec == pytest.approx(max(min(np.linalg.norm(x - y) for y in v2) for x in v1))
    assert got[1].log_diff_word2vec == pytest.approx(math.log1p(np.linalg.norm(v2.sum(axis=0) - v1.sum(axis=0)) / 7))
    assert all(x == 0 for x in got[2][1:])
    assert vectors._disparity(v1, v1 * 3 + 1) == pytest.approx(0, abs=1e-12)


def test_word_tokens(spark):
    got = spark.createDataFrame([("I can't go, it's 3.5... Really?",), (None,)], "q string").select(text.word_tokens(F.col("q")).alias("t")).collect()
    assert got[0].t == ["I", "ca", "n't", "go", ",", "it", "'s", "3.5", "...", "Really", "?"] and got[1].t == []
