"""Graph, frequency and ensemble operators against brute force; sources and sinks; streaming."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import lexicon
from pairloom.operators import ensemble, frames, signals
from pairloom.sources import store
from pairloom.streaming import features


def brute_cores(edges, most=20):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    core = dict.fromkeys(near, 0)
    for k in range(2, most + 1):
        left = {n: set(x) for n, x in near.items()}
        while low := [n for n, x in left.items() if len(x) < k]:
            for n in low:
                for m in left.pop(n):
                    left.get(m, set()).discard(n)
        for n in left:
            core[n] = k
    return core


def test_cores(spark):
    rng = np.random.default_rng(3)
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d")] + [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 25, (120, 2))]
    got = {r.node: r.core for r in signals.cores(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == brute_cores(edges) and got["a"] == 2 and got["d"] == 0


def test_cores_of_long_chains(spark):
    path = [(f"p{k}", f"p{k + 1}") for k in range(999)]
    ring = [(f"r{k}", f"r{(k + 1) % 50}") for k in range(50)]
    tail = [("r0", "t0")] + [(f"t{k}", f"t{k + 1}") for k in range(600)]
    tree = [(f"b{k}", f"b{(k - 1) // 2}") for k in range(1, 60)] + [("b59", "q0"), ("q0", "q1"), ("s0", "s1")]
    bell = [(f"{x}{a}", f"{x}{b}") for x in "xy" for a, b in ((0, 1), (1, 2), (2, 0))] + [("x0", "m0"), ("m0", "m1"), ("m1", "y0")]
    edges = path + ring + tail + tree + bell
    got = {r.node: r.core for r in signals.cores(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == brute_cores(edges) and got["p500"] == 0 and got["r7"] == 2 and got["m0"] == 2
    four = [(a, b) for a in "abcd" for b in "abcd" if a < b] + [("d", "e"), ("e", "f"), ("f", "a")]
    with pytest.raises(RuntimeError):
        signals.cores(spark.createDataFrame(four, "src string, dst string"), rounds=0)


def test_pagerank_keeps_repeats_and_sums_to_one(spark):
    edges = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "c")]
    got = {r.node: r.pr for r in signals.pagerank(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert sum(got.values()) == pytest.approx(1) and got["b"] > got["a"]


def test_ids_and_first_seen(spark):
    texts = spark.createDataFrame([("b",), ("a",), ("k",), ("a",)], "q string")
    known = spark.createDataFrame([("k", 1), ("k", 7)], "q string, qid long")
    assert {r.q: r.qid for r in signals.assign_ids(texts, known).collect()} == {"k": 7, "a": 538001, "b": 538002}


def test_ensembles(spark):
    rows = [("m", 1, 0.2), ("m", 2, 0.2), ("m", 3, 0.9), ("n", 1, 0.5), ("n", 2, 0.1), ("n", 3, 0.0)]
    p = spark.createDataFrame(rows, "model string, id long, p double")
    assert {r.id: r.p for r in ensemble.geometric_mean(p).collect()}[3] == 0
    with pytest.raises(KeyError):
        ensemble.weighted_mean(p, spark.createDataFrame([("m", 1.0)], "model string, weight double"))


def test_frames(spark):
    p = spark.createDataFrame([(i, i, i + 1, "long enough text", "another long text", int(i % 4 == 0)) for i in range(40)], store.TRAIN)
    assert frames.rebalance(p).count() == 30 + 8 + 30
    assert frames.oversample_positives(p, F.col("id")).count() == 40 + 10
    assert frames.symmetrized(p).count() == 80
    assert {r.fold for r in frames.folds(p, 5).collect()} == set(range(5))
    aligned = frames.aligned(p, spark.createDataFrame([(0, None), (1, 2.0)], "id long, f double")).orderBy("id").limit(3).collect()
    assert [r.f for r in aligned] == [None, 2.0, 0.0]
    odd = spark.createDataFrame([(0, float("inf")), (1, float("nan"))], "id long, g double")
    assert [r.g for r in frames.assemble(p.select("id"), [odd]).orderBy("id").limit(3).collect()] == [0, 0, 0]
    assert frames.unify(p, spark.createDataFrame([(9, "a", "b")], store.TEST)).filter("is_duplicate = -1").count() == 1
    tokens = F.array(*(frames.token_facts(t, e) for t, e in (("see", ""), ("New", "GPE"), ("York", "GPE"), ("now", ""))))
    assert p.limit(1).select(frames.entity_text(tokens)).first()[0] == "see country now"


def test_sources(spark, tmp_path):
    p = spark.createDataFrame([(1, 2, 3, 'a "quoted"\nline', "b,c", 0)], store.TRAIN)
    store.write_csv(p, str(tmp_path / "pairs"), "run1")
    assert store.read_csv(spark, str(tmp_path / "pairs_run1"), store.TRAIN).collect() == p.collect()
    assert store.read_csv(spark, str(tmp_path / "pairs_run1"), store.TRAIN, columns=["qid1"], most=2).columns == ["qid1"]
    vec = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "w.bin").write_bytes(b"2 3\n" + b"".join(w + b" " + v.tobytes() + b"\n" for w, v in zip((b"one", b"two"), vec, strict=True)))
    got = {r.word: list(r.vec) for r in store.read_word2vec(spark, str(tmp_path / "w.bin")).collect()}
    assert got == {"one": [0, 1, 2], "two": [3, 4, 5]}
    np.save(tmp_path / "a.npy", vec)
    assert [list(r["values"]) for r in store.read_npy(spark, str(tmp_path / "a.npy")).orderBy("nth").collect()] == vec.tolist()
    (tmp_path / "m1.csv").write_text("test_id,is_duplicate\n1,0.5\n")
    (tmp_path / "m2.csv").write_text("is_duplicate,test_id\n0.25,1\n")
    assert {(r.model, r.id, r.p) for r in store.read_predictions(spark, str(tmp_path / "m*.csv")).collect()} == {("m1", 1, 0.5), ("m2", 1, 0.25)}
    made = []
    for _ in range(2):
        out = store.cached(spark, f"file://{tmp_path}/cache", ["x"], lambda: made.append(1) or p)
    assert len(made) == 1 and out.count() == 1


def test_lexicon(spark):
    s = lexicon.Sentences({"dog": ["d"], "cat": ["c"], "car": ["r"]}, {"d": ["animal"], "c": ["animal"], "animal": ["thing"], "r": ["thing"]}, {"d": ["dog"], "c": ["cat"]}, {"dog": 1, "cat": 2})
    assert s.similarity(["dog"], ["dog"])[0] == pytest.approx(1) and s.word_similarity("dog", "cat") > s.word_similarity("dog", "car")
    assert s.similarity([], []) == (0.0, 1.0, pytest.approx(0.15))


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b", "a c"), (2, "", "x")], "id long, question1 string, question2 string")
    df.write.parquet(str(tmp_path / "in"))
    stream = features.overlap_features(features.pair_stream(spark, str(tmp_path / "in"), df.schema))
    q = stream.writeStream.format("memory").queryName("pairs_out").option("checkpointLocation", os.fspath(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.jaccard for r in spark.sql("SELECT * FROM pairs_out").collect()} == {1: pytest.approx(1 / 3), 2: 0}
