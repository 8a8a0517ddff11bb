"""What travels and what is held does not outgrow the input: shuffled bytes and the sizes of pieces, by Spark's own counts."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.operators import signals


def shuffled(spark, run) -> int:
    """Bytes that the stages of a run wrote for others."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, gate = sc._jsc.sc().statusStore(), sc._gateway

    def all_stages() -> dict:
        stages = store.stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(k) for k in range(stages.size()))}

    before = all_stages()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return sum(v for k, v in all_stages().items() if k not in before)


def test_links_stay_through_the_sweeps_of_pagerank(spark):
    rng = np.random.default_rng(5)
    edges = spark.createDataFrame([(f"a{x}", f"b{y}") for x, y in rng.integers(0, 150, (40_000, 2)).tolist()], "src string, dst string").cache()
    edges.count()
    few, many = (shuffled(spark, lambda k=k: signals.pagerank(edges, sweeps=k).count()) for k in (1, 4))
    assert (many - few) / 3 < 40_000


def test_pagerank_of_blocks_equals_the_definition(spark, monkeypatch):
    monkeypatch.setattr(signals, "BLOCK_NODES", 16)
    monkeypatch.setattr(signals, "PIECE_LINKS", 20)
    rng = np.random.default_rng(6)
    edges = [(f"n{x}", f"n{y}") for x, y in rng.integers(0, 60, (400, 2)).tolist()] + [("n0", "n0"), ("n1", "n2"), ("n1", "n2")]
    got = {r.node: r.pr for r in signals.pagerank(spark.createDataFrame(edges, "src string, dst string"), sweeps=5).collect()}
    both = edges + [(b, a) for a, b in edges]
    degree = {x: sum(a == x for a, _ in both) for x, _ in both}
    rank = dict.fromkeys(degree, 1 / len(degree))
    for _ in range(5):
        new = dict.fromkeys(degree, 0.15 / len(degree))
        for a, b in both:
            new[b] += 0.85 * rank[a] / degree[a]
        rank = new
    assert got == pytest.approx(rank, abs=1e-12)


def test_few_pairs_become_objects_at_a_time(spark, monkeypatch):
    from pairloom.functions import pairs

    batch = 10_000 * [["a", "b"]]
    held = []

    class Frame:
        columns = ["id", "t1", "t2"]
        schema = spark.createDataFrame([], "id long, t1 array<string>, t2 array<string>").schema
        select = lambda self, *c: self
        mapInArrow = lambda self, run, schema: run

    class Column:
        def __init__(self, rows):
            self.rows = rows

        def slice(self, lo, n):
            return Column(self.rows[lo : lo + n])

        def to_pylist(self):
            held.append(len(self.rows))
            return self.rows

    class Batch:
        num_rows = len(batch)
        column = lambda self, c: pa.array(range(len(batch))) if c == "id" else Column(batch)

    for make in (pairs.stem_counts, pairs.character_freq, pairs.syllable_similarity, pairs.profiles):
        assert [b.num_rows for b in make(Frame())(iter([Batch()]))] == [10_000]
    assert max(held) <= 100


def test_stems_of_odd_arrays(spark):
    from pairloom.functions import stem

    rows = [(0, ["running", "dogs"]), (1, None), (2, []), (3, [None, "dogs"])]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    assert {r.id: r.t for r in df.select("id", stem.stems(F.col("t")).alias("t")).collect()} == {0: ["run", "dog"], 1: None, 2: [], 3: [None, "dog"]}


def test_a_text_is_searched_for_places_once(spark):
    from pairloom.plans import catalog

    plan = catalog.QUERIES["places"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_profiles_share_a_pass_and_no_text_is_paired_twice(spark, monkeypatch):
    from pairloom.plans import catalog

    seen = []
    monkeypatch.setattr(catalog, "token_pairs", lambda *a, f=catalog.token_pairs: seen.append(a) or f(*a))
    catalog.text_profiles(spark, "/root/testdata/sf0.001").count()
    catalog.QUERIES["feature_table"](spark, "/root/testdata/sf0.001")
    assert len(seen) == 3  # text_profiles twice, and overlap_weighted


def test_last_known_words(spark):
    index = spark.createDataFrame([("a", 1), ("b", 2)], "word string, idx int")
    texts = spark.createDataFrame([(0, ["a", "x", "b", "b"]), (1, None), (2, ["x"])], "doc_id long, t array<string>")
    assert {r.doc_id: r.seq for r in signals.last_known(texts, index, 2).collect()} == {0: [2, 2], 1: [0, 0], 2: [0, 0]}
    assert {r.doc_id: r.seq for r in signals.last_known(texts, index, 4).collect()}[0] == [0, 1, 2, 2]


def test_synonyms_meet_both_texts_in_one_join(spark):
    from pairloom.operators import frames

    p = spark.createDataFrame([(0, "a a a", None), (1, "a", ""), (2, "b a c", "a  a a")], "id long, question1 string, question2 string")
    out = frames.with_synonyms(p, spark.createDataFrame([("a", "z")], "word string, synonym string"))
    assert {tuple(r) for r in out.collect()} == {(0, "a z a", None), (1, "a", ""), (2, "b z c", "a  z a")}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
