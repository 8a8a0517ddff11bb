"""Operators without SQL against definitions written out in Python, and numbering at size."""

import collections
import difflib
import itertools
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pairloom.functions import cleanup, editdist, lexicon, order, pairs, vectors
from pairloom.functions.stem import stem, stems
from pairloom.operators import ensemble, frames, signals
from pairloom.plans import catalog, models
from pairloom.sources import store

SF = "/root/testdata/sf0.001"


def test_numbering_of_many_rows(spark):
    """Equal to an exact window, on 300,000 rows of two models, with tasks merged at run time."""
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        n = 300_000
        p = spark.range(n).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), "id", F.pmod(F.xxhash64("id", "model"), F.lit(50_000)).cast("double").alias("p"))
        rows = p.toPandas()
        got = ensemble.rank_average(p).toPandas().set_index("id")["p"]
        rows = rows.sort_values(["model", "p", "id"])
        rows["k"] = rows.groupby("model").cumcount()
        mean = rows.groupby("id")["k"].mean().reset_index().sort_values(["k", "id"])
        want = pd.Series(np.arange(n) / (n - 1), mean["id"].to_numpy())
        assert np.array_equal(got.sort_index().to_numpy(), want.sort_index().to_numpy())
        pairs = spark.range(n).select("id", F.pmod("id", F.lit(3)).cast("int").alias("is_duplicate"))
        folds = frames.folds(pairs, 7).toPandas().sort_values("id")
        assert np.array_equal(folds["fold"].to_numpy(), (folds["id"] // 3 % 7).to_numpy())
        drawn = frames.drawn_positives(pairs.withColumn("is_duplicate", (F.col("is_duplicate") == 0).cast("int")), F.md5(F.col("id").cast("string").cast("binary")))
        assert drawn.count() == n // 2 - n // 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rank_average_by_hand(spark):
    rows = [("m", 1, 0.2), ("m", 2, 0.2), ("m", 3, 0.9), ("n", 1, 0.5), ("n", 2, 0.1), ("n", 3, 0.0)]
    got = {r.id: r.p for r in ensemble.rank_average(spark.createDataFrame(rows, "model string, id long, p double")).collect()}
    assert got == {1: 0.0, 2: 0.5, 3: 1.0}  # all mean ranks are 1; ties go by id


def test_expanding_correlation_keeps_digits(spark):
    rng = np.random.default_rng(5)
    x, y = 1e6 + rng.random(500), 1e6 + rng.random(500)
    df = spark.createDataFrame([(m, i, float(v)) for m, c in (("x", x), ("y", y)) for i, v in enumerate(c)], "model string, id long, p double")
    got = {r.id: r["corr"] for r in ensemble.expanding_correlation(df, "x", "y").collect()}
    assert got[0] is None and all(got[i] == pytest.approx(np.corrcoef(x[: i + 1], y[: i + 1])[0, 1], abs=1e-6) for i in (5, 77, 499))


def kendall_brute(x, y):
    s = xt = yt = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        a, b = (x[i] > x[j]) - (x[i] < x[j]), (y[i] > y[j]) - (y[i] < y[j])
        s, xt, yt = s + a * b, xt + (a == 0), yt + (b == 0)
    n = len(x) * (len(x) - 1) // 2
    return s / math.sqrt((n - xt) * (n - yt)) if xt < n and yt < n else math.nan


def test_kendall_brute_force():
    rng = np.random.default_rng(4)
    for n in range(2, 30):
        x, y = rng.integers(0, 6, n).tolist(), rng.integers(0, 6, n).tolist()
        assert order.kendall(x, y)[0] == pytest.approx(kendall_brute(x, y), nan_ok=True)
    # by the normal approximation: S = 6, its variance 4 * 3 * 13 / 18
    assert order.kendall([0, 1, 2, 3], [0, 1, 2, 3])[1] == pytest.approx(math.erfc(6 / math.sqrt(156 / 18) / math.sqrt(2)))


def test_sequence_ratio_brute_force(spark):
    got = {r.id: r.string_similarity for r in catalog.seq_ratio(spark, SF).collect()}
    for r in catalog.part_pairs(spark, SF).limit(50).collect():
        a, b = ("".join(c for c in t if c.isalnum()) for t in (r.question1, r.question2))
        assert got[r.id] == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio(), abs=1e-6)


def test_stems_of_known_words(spark):
    # Words and stems that the algorithm's authors publish.
    known = "consign consigned consigning consignment consist consisted consistency consistent consistently consisting consists knack knackeries knacks knave knaves knavish knees knell knelt knight knightly knights knock knocked knocker knocking knocks knoll knot knots".split()
    want = "consign consign consign consign consist consist consist consist consist consist consist knack knackeri knack knave knave knavish knee knell knelt knight knight knight knock knock knocker knock knock knoll knot knot".split()
    assert [stem(w) for w in known] == want
    assert spark.createDataFrame([(known,)], "t array<string>").select(stems(F.col("t")).alias("s")).first().s == want


def test_stem_features_brute_force(spark):
    got = {r.id: r for r in catalog.stem_features(spark, SF).collect()}
    for r in catalog.token_pairs(spark, SF).limit(40).collect():
        a, b = (collections.Counter(map(stem, t)) for t in (r.t1, r.t2))
        both = a.keys() & b.keys()
        share = 2 * len(both) / (len(a) + len(b)) if a and b else 0
        freq = sum(a[k] / len(r.t1) + b[k] / len(r.t2) for k in both) - sum(a[k] / len(r.t1) for k in a.keys() - both) - sum(b[k] / len(r.t2) for k in b.keys() - both) if a and b else 0
        assert got[r.id].stems_share == pytest.approx(share, abs=1e-6) and got[r.id].stems_freq == pytest.approx(freq, abs=1e-5)


def clean_brute(t):
    low = lambda m: m[0].lower()
    t = (t[:1].lower() + t[1:]) if t else ""
    t = re.sub(r"(?<=[.?!)'\"])\s*.", low, t)
    for a, b in cleanup.TYPOGRAPHIC.items():
        t = t.replace(a, b)
    for pattern, put, any_case in (*cleanup.CONTRACTIONS, *cleanup.SPELLING, *cleanup.NUMBERS_AND_SIGNS, *cleanup.LAST):
        if pattern.startswith("(?=[a-zA-Z])ig"):
            pattern = r"(?<=[a-zA-Z]{3})ig "
        t = re.sub(pattern, re.sub(r"\$(\d)", r"\\g<\1>", put), t, flags=re.I if any_case else 0)
    return t.strip(" ")


def test_cleanup_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    texts += ["It's 15k, I can't; i'm \"HERE\".  Really?(Yes) e.g. J.K. Rowling's 3.14% & $5", "big Dog. Dig deep! what's  UP", "the intially e-mail kms gps upvoted", "a1,234,567 b.g. (s) C:/x _ caf\u00e9 \u2019s", "demonitisation X demonetisation y", " childern ", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r.id: r.c for r in df.select("id", cleanup.clean(F.col("t")).alias("c")).collect()}
    wrong = [(t, got[i], clean_brute(t)) for i, t in enumerate(texts) if got[i] != clean_brute(t)]
    assert not wrong, wrong[:1]


def similarity_brute(a, b, synsets, up, counts, n):
    """Li and others' similarity of two token lists."""
    def above(s):
        out, todo = {s: 0}, [s]
        for x in todo:
            for p in up.get(x, ()):
                if p not in out:
                    out[p] = out[x] + 1
                    todo.append(p)
        return out

    def words(v, w):
        best = min(((above(x)[k] + above(y)[k], x, y) for x in synsets.get(min(v, w), ()) for y in synsets.get(max(v, w), ()) for k in above(x).keys() & above(y).keys()), default=None)
        if best is None:
            return 0.0
        d, x, y = best
        if x != y and {u for u, s in synsets.items() if x in s} & {u for u, s in synsets.items() if y in s}:
            d = 1
        deep = max(max(above(k).values()) for k in above(x).keys() & above(y).keys())
        return math.exp(-0.2 * d) * math.tanh(0.45 * deep)

    info = lambda w: 1 - math.log(counts.get(w, 0) + 1) / math.log(n + 1)
    near = lambda w, t: min(((-words(w, v), v) for v in set(t)), default=(1.0, ""))
    every = sorted({*a, *b})
    s, o = [], []
    for t in (a, b):
        found = {w: near(w, t) for w in every if w not in t}
        s.append([info(w) ** 2 if w in t else 0.2 * (-found[w][0] > 0.2) * info(w) * info(found[w][1]) for w in every])
        o.append([t.index(w) if w in t else t.index(found[w][1]) if -found[w][0] > 0.4 else 0 for w in every])
    size = math.hypot(*s[0]) * math.hypot(*s[1])
    sem = sum(x * y for x, y in zip(*s, strict=True)) / size if size else 0.0
    plus = math.hypot(*(x + y for x, y in zip(*o, strict=True)))
    word = 1 - math.hypot(*(x - y for x, y in zip(*o, strict=True))) / plus if plus else 1.0
    return sem, word, 0.85 * sem + 0.15 * word


def test_sentence_similarity_brute_force(spark):
    got = {r.id: r for r in catalog.sentence_similarity(spark, SF).collect()}
    p = catalog.part_tokens(spark, SF).collect()
    counts = collections.Counter(w for r in p for w in (*r.t1, *r.t2))
    synset, hypernym, _ = (df.collect() for df in catalog.part_lexicon(spark, SF))
    synsets, up = collections.defaultdict(list), collections.defaultdict(list)
    for r in synset:
        synsets[r.word].append(r.synset)
    for r in hypernym:
        up[r.synset].append(r.parent)
    for r in p[:40]:
        want = similarity_brute(r.t1, r.t2, synsets, up, counts, sum(counts.values()))
        assert (got[r.id].semantic_similarity, got[r.id].word_order_similarity, got[r.id].similarity) == pytest.approx(want, abs=2e-6)


def test_hierarchy_distances():
    up = {"a": ["m"], "b": ["m"], "m": ["top"], "c": ["top"]}
    published, literal = (lexicon.Sentences({}, up, {}, n=1, compat=c) for c in (False, True))
    assert published.hierarchy_dist("a", "b") == pytest.approx(math.tanh(0.45)) and published.hierarchy_dist("a", "c") == 0
    assert literal.hierarchy_dist("a", "b") == pytest.approx(math.tanh(0.45 * 2)) and literal.hierarchy_dist("a", "a") == pytest.approx(math.tanh(0.9))
    with pytest.raises(ValueError):
        lexicon.MOST_ENTRIES, kept = 1, lexicon.MOST_ENTRIES
        try:
            catalog_like = type("T", (), {"count": lambda self: 1})()
            lexicon.sentences(catalog_like, catalog_like, catalog_like, 1)
        finally:
            lexicon.MOST_ENTRIES = kept


def test_procrustes_brute_force(spark):
    rng = np.random.default_rng(1)
    sets = [[rng.normal(size=(a, 6)).tolist(), rng.normal(size=(b, 6)).tolist()] for a, b in ((3, 5), (4, 4), (1, 4), (0, 2), (2, 2))]
    df = spark.createDataFrame([(i, *s) for i, s in enumerate(sets)], "id long, x array<array<double>>, y array<array<double>>")
    got = {r.id: r.d for r in df.select("id", vectors.procrustes(F.col("x"), F.col("y"), 4).alias("d")).collect()}
    for i, (x, y) in enumerate(sets):
        n = min(len(x), len(y), 4)
        if n < 2:
            assert got[i] == 0
            continue
        a, b = (np.array(v[:n]) - np.mean(v[:n], axis=0) for v in (x, y))
        a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
        u, s, vt = np.linalg.svd(b.T @ a)
        assert got[i] == pytest.approx(((a - s.sum() * b @ (u[:, : len(s)] @ vt[: len(s)])) ** 2).sum())


def entity_brute(tokens):
    """The rules one after the other over (text, ent, type, second, lemma, known, lemma_known)."""
    out, before = [], None
    number = lambda k: k in frames.NUMERIC_TYPES
    for text, ent, kind, second, lemma, known, lemma_known in tokens:
        kind = kind or ent
        if text in frames.SPECIAL_TOKENS:
            out.append(ent or text)
            before = ent or None
        elif not text or not (text[0].isalpha() or text[0].isdigit()) or text == "s":
            before = None
        elif before in (kind, ent) or (number(before) and (number(kind) or number(ent))):
            pass
        elif text.isdigit():
            if not number(before):
                out.append("number")
                before = "QUANTITY"
        elif kind:
            out.append(frames.ENTITY_WORDS[kind])
            before = kind
        elif text.lower() == lemma and text[1:] != lemma[1:] and second:
            out.append(frames.ENTITY_WORDS[second])
            before = second
        elif lemma_known:
            out.append(lemma)
            before = None
        elif second:
            out.append(frames.ENTITY_WORDS[second])
            before = second
        else:
            out.append(text.lower() if known else text)
            before = None
    return " ".join(out)


def test_entity_text_brute_force(spark):
    rng = np.random.default_rng(3)
    pick = lambda x: x[int(rng.integers(len(x)))]
    rows = []
    for i in range(200):
        t = []
        for _ in range(int(rng.integers(0, 9))):
            w = pick(["see", "New", "iPhone", "42", "7", "s", "!", "quoted_item", "(", "USA", "went", "something"])
            t.append((w, pick(["", "", "GPE", "DATE", "CARDINAL", "PERSON"]), pick(["", "", "GPE", "MONEY"]), pick(["", "ORG", "TIME"]), pick([w.lower(), "go"]), bool(rng.integers(2)), bool(rng.integers(2))))
        rows.append((i, t))
    df = spark.createDataFrame(rows, "id long, t array<struct<text: string, ent: string, type: string, second: string, lemma: string, known: boolean, lemma_known: boolean>>")
    got = {r.id: r.x for r in df.select("id", frames.entity_text(F.col("t")).alias("x")).collect()}
    assert all(got[i] == entity_brute(t) for i, t in rows)


def test_synonyms(spark):
    lex = spark.createDataFrame([("big", "ADJ", "very_large"), ("run", "VERB", "go"), ("person", "NOUN", "human"), ("dog", "NOUN", None)], "word string, pos string, lemma string")
    p = spark.createDataFrame([(1, 1, "big a big dog", "a big"), (2, 1, None, "x person run y")], "id long, is_duplicate int, question1 string, question2 string")
    got = {r.id: (r.question1, r.question2) for r in frames.with_synonyms(p, frames.synonym_choice(lex)).collect()}
    assert got == {1: ("big a very large dog", "a big"), 2: (None, "x person run y")}


def test_pair_graph_keeps_repeats_and_loops(spark):
    p = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "c", "c"), (4, None, "a")], "id long, question1 string, question2 string")
    g = signals.pair_graph(p)
    out = {r.id: r for r in signals.with_graph(p, signals.pagerank(g), signals.cores(g)).collect()}
    assert g.count() == 4 and out[1].q1_pr > out[1].q2_pr and out[3].q1_max_kcore == 0 and out[4].q1_pr > 0


def test_files_of_arrays_and_predictions(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(50)], "nth long, values array<double>")
    store.write_npy(rows, f"file://{tmp_path}/npy")
    back = store.read_npy(spark, f"file://{tmp_path}/npy").orderBy("file", "nth").collect()
    assert [list(r["values"]) for r in back] == [[float(i), 2.0 * i] for i in range(50)]
    p = spark.createDataFrame([(7, 0.25), (9, 0.5)], "id long, p double")
    store.write_predictions(p, str(tmp_path / "best.csv"))
    assert {(r.model, r.id, r.p) for r in store.read_predictions(spark, str(tmp_path / "best.csv" / "*.csv")).collect()} and spark.read.option("header", True).csv(str(tmp_path / "best.csv")).columns == ["test_id", "is_duplicate"]


def test_cache_sees_changed_files(spark, tmp_path):
    made = []
    for text in ("a", "a", "bb"):
        (tmp_path / "in").mkdir(exist_ok=True)
        if not made or text == "bb":
            (tmp_path / "in" / "x.txt").write_text(text)
        store.cached(spark, f"file://{tmp_path}/cache", [f"file://{tmp_path}/in", "v1"], lambda text=text: made.append(text) or spark.createDataFrame([(text,)], "x string"))
    assert made == ["a", "bb"]


def test_models_learn_save_and_predict_unlabelled_rows(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 3))
    y = [float(v) if i % 6 else None for i, v in enumerate(x[:, 0] + 0.3 * x[:, 1] > 0)]
    df = spark.createDataFrame([(i, y[i], *map(float, r)) for i, r in enumerate(x)], "id long, label double, a double, b double, c double")
    model = models.fit_boosted(df, rounds=8, step=0.3, depth=3)
    assert models.importances(model)[0][0] == "a"
    again = models.load(models.save(model, f"file://{tmp_path}/model"))
    p = {r.id: r.p for r in models.predict(again, df).collect()}
    assert p == {r.id: r.p for r in models.predict(model, df).collect()} and len(p) == 240
    true = x[:, 0] + 0.3 * x[:, 1] > 0
    assert np.mean([(p[i] > 0.5) == true[i] for i in range(0, 240, 6)]) > 0.8
    out = {r.id: r.p for r in models.stacked(df, k=2, trees=5, rounds=3, deepest=4).collect()}
    assert len(out) == 240 and min(out.values()) == 0 and max(out.values()) == 1
    assert np.mean([(out[i] > 0.5) == true[i] for i in range(0, 240, 6)]) > 0.8


def test_path_similarity_over_permutations(spark):
    known = {"a|x": 0.5, "b|y": 0.25, "a|z": 1.0}
    df = spark.createDataFrame([(["a", "b"], ["x", "y", "z"], known), ([], ["x"], known)], "s array<string>, t array<string>, m map<string,double>")
    got = [r.d for r in df.select(lexicon.cross_path_similarity(F.col("s"), F.col("t"), F.col("m")).alias("d")).collect()]
    want = sum(known.get(f"a|{p}", 0) + known.get(f"b|{q}", 0) for p, q in itertools.permutations("xyz", 2)) / 5
    assert got == [pytest.approx(want), 0.0]


def test_edit_distance_of_other_costs():
    d = editdist.EditDistance("abc", "axc", insertion=lambda x: 2, deletion=lambda x: 3, substitution=lambda x, y: 0 if x == y else 10)
    assert d.cost == 5 and {"".join(s[0] for s in a) for a in d.alignments()} == {"MIDM", "MDIM"}
    long = editdist.EditDistance("a" * 30, "b" * 20).alignments()
    assert len(list(itertools.islice(long, 5))) == 5  # without listing all of them first


def test_replaced_words(spark):
    df = spark.createDataFrame([("a big dog, a big cat",)], "q string")
    assert df.select(cleanup.replace_words(F.col("q"), {" big ": " large ", "dog|cat": "pet"})).first()[0] == "a large pet, a large pet"


def test_places_compared_with_themselves(spark):
    df = spark.createDataFrame([("Paris, Rome", "Oslo"), ("", "Oslo")], "a string, b string")
    f = pairs.places(F.col("a"), F.col("b"), ["Paris", "Rome", "Oslo"], compat=True)
    assert [tuple(r) for r in df.select(*f.values()).collect()] == [(2, 0, 4), (0, 0, 0)]
    with pytest.raises(ValueError):
        pairs.places(F.col("a"), F.col("b"), ["x"] * (pairs.MOST_NAMES + 1))


def test_lines_and_other_encodings(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a,b,c\n\nd")
    assert sorted(r.fields for r in store.read_lines(spark, str(tmp_path / "x.txt")).collect()) == [[""], ["a", "b", "c"], ["d"]]
    (tmp_path / "y.csv").write_bytes("test_id,question1,question2\n1,caf\xe9,\xdcber\n".encode("latin-1"))
    assert store.read_csv(spark, str(tmp_path / "y.csv"), store.TEST, encoding="ISO-8859-1").collect() == [(1, "caf\xe9", "\xdcber")]
