"""Corpus signals: word weights, text frequency, ids of texts, PageRank and k-cores of the pair graph."""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import pad_sequence
from ..sources.store import materialize


def word_counts(pairs: DataFrame, t1: Column, t2: Column) -> DataFrame:
    """(word, n) over both sides."""
    words = pairs.select(F.explode(F.concat(F.coalesce(t1, F.array().cast("array<string>")), F.coalesce(t2, F.array().cast("array<string>")))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def word_weight(n: Column, least: int = 2, eps: int = 10_000) -> Column:
    return F.when(n < least, 0.0).otherwise(1.0 / (n + eps))


def weighted_match(pairs: DataFrame, counts: DataFrame, stops: list[str]) -> DataFrame:
    """(id, tfidf_wm, tfidf_wm_stops) of (id, t1, t2): twice the weights of shared distinct words over all weights, with and without stopwords.

    0 if a side is empty, null if nothing weighs. Words of weight 0 do not travel. The weights are written,
    so that Spark knows their size: a small table meets the words where they lie, by id as the sums need
    them; a large one meets them by word, where AQE splits a word that every text has.
    """
    weights = materialize(counts.select("word", word_weight(F.col("n")).alias("w")).filter("w > 0"))
    u1, u2 = F.array_distinct("t1"), F.array_distinct("t2")
    plain = lambda t: F.exists(t, lambda x: ~x.isin(stops)) if stops else F.size(t) > 0
    both = (F.size("t1") > 0) & (F.size("t2") > 0)
    known = pairs.select("id", F.coalesce(both, F.lit(False)).alias("some"), F.coalesce(both & plain("t1") & plain("t2"), F.lit(False)).alias("some_plain"))
    tagged = lambda words, k: F.transform(words, lambda x: F.struct(x.alias("word"), F.lit(k).alias("k")))
    words = pairs.select("id", F.inline(F.concat(tagged(F.array_intersect(u1, u2), 2), tagged(F.array_except(u1, u2), 1), tagged(F.array_except(u2, u1), 1))))
    rest = ~F.col("word").isin(stops) if stops else F.lit(True)
    own, shared = F.col("w") * F.col("k"), F.when(F.col("k") == 2, F.col("w") * 2).otherwise(0.0)
    match = lambda on: F.try_divide(F.sum(F.when(on, shared).otherwise(0.0)), F.sum(F.when(on, own).otherwise(0.0)))
    sums = words.join(weights, "word").groupBy("id").agg(match(F.lit(True)).alias("m"), match(rest).alias("m_plain"))
    said = lambda on, c, name: F.when(F.col(on), F.col(c)).otherwise(0.0).alias(name)
    return known.join(sums, "id", "left").select("id", said("some", "m", "tfidf_wm"), said("some_plain", "m_plain", "tfidf_wm_stops"))


def text_frequency(pairs: DataFrame) -> DataFrame:
    """(id, q1_freq, q2_freq): how often each text stands on either side."""
    sides = pairs.select(F.col("question1").alias("q")).union(pairs.select("question2"))
    n = materialize(sides.groupBy(F.md5(F.coalesce("q", F.lit("")).cast("binary")).alias("h")).agg(F.count("*").alias("n")))
    key = lambda c: F.md5(F.coalesce(F.col(c), F.lit("")).cast("binary"))
    out = pairs.select("id", key("question1").alias("h1"), key("question2").alias("h2"))
    for k in ("1", "2"):
        out = out.join(n.select(F.col("h").alias(f"h{k}"), F.col("n").alias(f"q{k}_freq")), f"h{k}")
    return out.select("id", "q1_freq", "q2_freq")


def first_seen(texts: DataFrame, order: str) -> DataFrame:
    """(q, ordinal): distinct texts numbered by first appearance, from 0."""
    first = texts.groupBy("q").agg(F.min(order).alias("at"))
    ranged = first.repartitionByRange("at").withColumn("p", F.spark_partition_id())
    ranged = materialize(ranged)
    sizes = ranged.groupBy("p").agg(F.count("*").alias("n"))
    base = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    nth = F.row_number().over(Window.partitionBy("p").orderBy("at")) - 1
    return ranged.withColumn("nth", nth).join(base, "p").select("q", (F.col("nth") + F.col("base")).cast("long").alias("ordinal"))


def assign_ids(texts: DataFrame, known: DataFrame, start: int = 538_000) -> DataFrame:
    """(q, qid): the known id of each distinct text, else start + its number among the unknown, in order of text."""
    last = known.groupBy("q").agg(F.max("qid").alias("qid"))
    said = texts.select("q").distinct().join(last, "q", "left")
    fresh = first_seen(said.filter("qid IS NULL").select("q", F.col("q").alias("at")), "at").select("q", (F.col("ordinal") + start + 1).alias("qid"))
    return said.filter("qid IS NOT NULL").unionByName(fresh)


def numbered(links: DataFrame) -> DataFrame:
    """links with src and dst as numbers, one for each distinct node, in no order; written. Wide names then travel once, not in every round of what follows."""
    names = links.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    known = materialize(names.withColumn("nth", F.monotonically_increasing_id()))
    for side in ("src", "dst"):
        links = links.join(known.select(F.col("node").alias(side), F.col("nth").alias(f"__{side}")), side).drop(side).withColumnRenamed(f"__{side}", side)
    return materialize(links)


#: Blocks of nodes, unless one would hold more nodes than these; links in one piece.
BLOCKS, BLOCK_NODES, PIECE_LINKS = 8, 1 << 22, 1 << 21


def _pieces(edges: DataFrame, nodes: DataFrame, blocks: int, parts: int) -> DataFrame:
    """(piece, i, j, a, b): the places in blocks i <= j of the links between both, as 32-bit numbers in two binaries. A pair of blocks has ``parts`` pieces."""
    coded = edges.select("src", "dst")
    for side, b, at in (("src", "i", "a"), ("dst", "j", "b")):
        to = nodes.select(F.col("node").alias(f"__{side}"), F.col("block").alias(b), F.col("at").alias(at))
        coded = coded.join(to, F.col(side).eqNullSafe(F.col(f"__{side}"))).drop(side, f"__{side}")
    turned = F.col("i") > F.col("j")
    swap = lambda x, y, name: F.when(turned, F.col(x)).otherwise(F.col(y)).alias(name)
    coded = coded.select(swap("j", "i", "i"), swap("i", "j", "j"), swap("b", "a", "a"), swap("a", "b", "b"))
    part = F.pmod(F.hash("a", "b"), F.lit(parts)) if parts > 1 else F.lit(0)
    coded = coded.withColumn("piece", ((F.col("i") * blocks + F.col("j")) * parts + part).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        row = {c: t.column(c)[:1].cast(pa.int32()) for c in ("piece", "i", "j")}
        return pa.table(row | {c: pa.array([t.column(c).to_numpy().astype(np.int32).tobytes()], pa.binary()) for c in ("a", "b")})

    return coded.groupBy("piece").applyInArrow(pack, "piece int, i int, j int, a binary, b binary")


def pagerank(edges: DataFrame, damping: float = 0.85, sweeps: int = 20) -> DataFrame:
    """(node, pr) of a multigraph (src, dst), both directions used, repeats and loops kept; all ranks of a sweep at once.

    Nodes are numbered within blocks, and links lie packed in pieces between two blocks, where they stay through all sweeps. In a sweep
    a piece gets the ranks of its two blocks and gives what both get from it, as vectors: some 16 bytes a node and block travel, no link.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    degree = materialize(ends.groupBy("node").agg(F.count("*").alias("deg")))
    n, total = degree.agg(F.count("*"), F.sum("deg")).first()
    if not n:
        return degree.select("node", F.lit(0.0).alias("pr"))
    blocks = max(min(BLOCKS, -(-n // (1 << 14))), -(-n // BLOCK_NODES))
    parts = -(-total // (blocks * (blocks + 1) * PIECE_LINKS))
    nodes = materialize(degree.repartition(blocks, "node").select("node", "deg", F.spark_partition_id().alias("block"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).cast("int").alias("at")))
    tasks = min(blocks * (blocks + 1) // 2 * parts, 2 * max(edges.sparkSession.sparkContext.defaultParallelism, 100))
    pieces = _pieces(edges, nodes, blocks, parts).repartition(tasks, "piece").persist(StorageLevel.DISK_ONLY)

    def of(t: pa.Table, c: str, k: int, kind=np.float64) -> np.ndarray:
        return np.frombuffer(t.column(c)[k].as_buffer(), kind)

    def shares(t: pa.Table) -> pa.Table:
        deg = np.zeros(t.num_rows)
        deg[t.column("at").to_numpy()] = np.where(t.column("node").is_null().to_numpy(), np.inf, t.column("deg").to_numpy())  # what has no name gives nothing
        return pa.table({"block": t.column("block")[:1].cast(pa.int32()), "deg": pa.array([deg.tobytes()], pa.binary()), "pr": pa.array([np.full(len(deg), 1.0 / n).tobytes()], pa.binary())})

    def give(links: pa.Table, ranks: pa.Table) -> pa.Table:
        got: dict[int, np.ndarray] = {}
        x = {b: of(ranks, "x", k) for k, b in enumerate(ranks.column("block").to_pylist())}
        for k in range(links.num_rows):
            i, j, a, b = links.column("i")[k].as_py(), links.column("j")[k].as_py(), of(links, "a", k, np.int32), of(links, "b", k, np.int32)
            for here, there, to, frm in ((j, i, b, a), (i, j, a, b)):
                s = np.bincount(to, x[there][frm], len(x[here]))
                got[here] = got[here] + s if here in got else s
        return pa.table({"block": pa.array(list(got), pa.int32()), "s": pa.array([v.tobytes() for v in got.values()], pa.binary())})

    def add(own: pa.Table, given: pa.Table) -> pa.Table:
        s = np.zeros(len(of(own, "deg", 0)))
        for k in range(given.num_rows):
            s += of(given, "s", k)
        return pa.table({"block": own.column("block"), "deg": own.column("deg"), "pr": pa.array([((1 - damping) / n + damping * s).tobytes()], pa.binary())})

    def divided(batches):
        for t in batches:
            for k in range(t.num_rows):
                x = of(t, "pr", k) / of(t, "deg", k)
                yield pa.RecordBatch.from_pydict({"block": t.column("block")[k : k + 1], "x": pa.array([x.tobytes()], pa.binary())})

    def rows(batches):
        for t in batches:
            for k in range(t.num_rows):
                v = of(t, "pr", k)
                for lo in range(0, len(v), 1 << 16):
                    part = v[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(part), t.column("block")[k].as_py(), np.int32)), "at": pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), "pr": pa.array(part)})

    held = "block int, deg binary, pr binary"
    pr = materialize(nodes.groupBy("block").applyInArrow(shares, held))
    pair = lambda k: F.least("block", k) * blocks + F.greatest("block", k)
    for _ in range(sweeps):
        near = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), pair))
        x = pr.mapInArrow(divided, "block int, x binary").select("block", "x", near.alias("k")).select("block", "x", F.explode(F.sequence(F.col("k") * parts, F.col("k") * parts + parts - 1)).alias("piece"))
        given = pieces.groupBy("piece").cogroup(x.repartition(tasks, "piece").groupBy("piece")).applyInArrow(give, "block int, s binary")
        pr = materialize(pr.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(add, held))
    pieces.unpersist()
    return nodes.join(pr.mapInArrow(rows, "block int, at int, pr double"), ["block", "at"]).select("node", "pr")


def with_nodes(pairs: DataFrame, values: DataFrame, left: str, right: str, names: tuple[str, str], value: str, how: str = "inner") -> DataFrame:
    """pairs with a node's value for both sides."""
    for side, name in zip((left, right), names, strict=True):
        pairs = pairs.join(values.select(F.col("node").alias(side), F.col(value).alias(name)), side, how)
    return pairs


def pair_graph(*tables: DataFrame) -> DataFrame:
    """Links (src, dst) between the texts of pairs, train and test alike, by md5 of question1 and question2; repeats and loops stay. A null text counts as empty."""
    node = lambda c: F.md5(F.coalesce(c, F.lit("")).cast("binary"))
    return reduce(DataFrame.unionByName, (t.select(node("question1").alias("src"), node("question2").alias("dst")) for t in tables))


def with_graph(pairs: DataFrame, ranks: DataFrame | None = None, core: DataFrame | None = None) -> DataFrame:
    """pairs with q1_pr, q2_pr and q1_max_kcore, q2_max_kcore, looked up by the texts' nodes; 0 for a text that the graph lacks."""
    node = lambda c: F.md5(F.coalesce(c, F.lit("")).cast("binary"))
    out = pairs.withColumn("__n1", node("question1")).withColumn("__n2", node("question2"))
    for values, value, names in ((ranks, "pr", ("q1_pr", "q2_pr")), (core, "core", ("q1_max_kcore", "q2_max_kcore"))):
        if values is not None:
            out = with_nodes(out, values, "__n1", "__n2", names, value, "left").fillna(0, list(names))
    return out.drop("__n1", "__n2")


def core_membership(core: DataFrame, least: int = 2, most: int = 20) -> DataFrame:
    """(node, kcore2, kcore3, ...): k where the node is in the k-core, else 0."""
    return core.select("node", *(F.when(F.col("core") >= k, k).otherwise(0).alias(f"kcore{k}") for k in range(least, most + 1)))


def _without_tails(both: DataFrame) -> DataFrame:
    """The links (src, dst, both directions) of the 2-core.

    A link dangles if src has no other one, or one other, and that dangles into src: by pointer jumping,
    links learn this in rounds by the logarithm of a chain's length. Nodes with a dangling link go, until none has one.
    """
    while True:
        ends = both.groupBy("src").agg(F.count("*").alias("d"), F.min("dst").alias("lo"), F.max("dst").alias("hi"))
        other = F.when(F.col("dst") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
        links = materialize(both.join(ends, "src").select("src", "dst", other.alias("a"), F.col("src").alias("b"), (F.col("d") == 1).alias("dangles"), (F.col("d") == 2).alias("open")))
        if links.filter("dangles").isEmpty():
            return both
        reach, n = 1, links.filter("open").count()
        while reach <= n:  # what is open after that many steps is on a ring
            to = links.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("dangles").alias("dangles2"), F.col("open").alias("open2"))
            ahead = links.filter("open").join(to, ["a", "b"]).select("src", "dst", F.col("a2").alias("a"), F.col("b2").alias("b"), F.col("dangles2").alias("dangles"), F.col("open2").alias("open"))
            links, reach = materialize(links.filter("NOT open").unionByName(ahead)), 2 * reach
            if links.filter("open").isEmpty():
                break
        gone = materialize(links.filter("dangles").select(F.col("src").alias("gone")).distinct())
        for side in ("src", "dst"):
            both = both.join(gone, F.col(side) == F.col("gone"), "left_anti")
        both = materialize(both)


def cores(edges: DataFrame, most: int = 20, rounds: int | None = None) -> DataFrame:
    """(node, core) of the simple graph without loops: the largest k, up to ``most``, whose k-core has the node; 0 below 2.

    Tails and trees go first. Every other node's bound starts at its degree and falls to the h-index of
    its neighbours' bounds until none changes; an error if ``rounds``, where given, do not suffice.
    Bounds above ``most`` are alike, so what a node keeps of its neighbours is that many counts.
    """
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = materialize(e.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(e.select("b", "a")))
    nodes = both.select(F.col("src").alias("node")).distinct()
    both = _without_tails(both)
    bound = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.count("*"), F.lit(most)).cast("int").alias("h")))
    for done in count():
        if done == rounds:
            raise RuntimeError(f"bounds still fall after {rounds} rounds")
        seen = both.join(bound.select(F.col("node").alias("dst"), "h"), "dst").groupBy("src").agg(*(F.sum((F.col("h") >= k).cast("long")).alias(f"n{k}") for k in range(1, most + 1)))
        new = F.greatest(*(F.when(F.col(f"n{k}") >= k, k).otherwise(0) for k in range(1, most + 1)), F.lit(0))
        both_bounds = seen.select(F.col("src").alias("node"), new.alias("new")).join(bound, "node").select("node", F.least("new", "h").alias("h"), (F.col("new") < F.col("h")).alias("fell"))
        both_bounds = materialize(both_bounds)
        bound = both_bounds.select("node", "h")
        if both_bounds.filter("fell").isEmpty():
            break
    return nodes.join(bound, "node", "left").select("node", F.when(F.col("h") >= 2, F.col("h")).otherwise(0).alias("core"))


def both_sequences(pairs: DataFrame, index: DataFrame, length: int = 30) -> DataFrame:
    """(id, seq1, seq2) of (id, t1, t2)."""
    side = lambda k: sequences(pairs.select("id", F.col(f"t{k}").alias("t")), index, length).withColumnRenamed("seq", f"seq{k}")
    return side(1).join(side(2), "id")


def last_known(texts: DataFrame, index: DataFrame, length: int = 30) -> DataFrame:
    """As sequences, of (doc_id, t), with an index that word_index bounds: texts are read from the end where they lie, as far as ``length`` known words reach."""
    known = texts.sparkSession.sparkContext.broadcast(dict(index.select("word", "idx").collect()))

    def run(batches):
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 64):
                for words in batch.column("t").slice(lo, 64).to_pylist():
                    got: list[int] = []
                    for w in reversed(words or []):
                        if len(got) == length:
                            break
                        if (k := known.value.get(w)) is not None:
                            got.append(k)
                    out.append([0] * (length - len(got)) + got[::-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "seq"])

    return texts.select("doc_id", "t").mapInArrow(run, T.StructType([texts.schema["doc_id"], T.StructField("seq", T.ArrayType(T.IntegerType()))]))


def null_embeddings(matrix: DataFrame) -> DataFrame:
    """(n_words, n_null) of (idx, word, vec): how many words, and how many whose numbers add up to 0."""
    total = F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return matrix.agg(F.count("*").alias("n_words"), F.count_if(total == 0).alias("n_null"))


def word_index(counts: DataFrame, most: int = 200_000) -> DataFrame:
    """(word, idx): the most frequent words, numbered from 1, ties by word. The numbering window sees ``most`` rows at most."""
    top = counts.orderBy(F.desc("n"), "word").limit(most)
    return top.select("word", F.row_number().over(Window.orderBy(F.desc("n"), "word")).alias("idx"))


def sequences(texts: DataFrame, index: DataFrame, length: int = 30) -> DataFrame:
    """(id, seq): the indexes of a text's known words (id, t), the last ``length`` of them, filled with 0 in front."""
    words = texts.select("id", F.posexplode("t").alias("at", "word")).join(index, "word")
    own = words.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "idx"))), lambda x: x["idx"]).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return texts.select("id").join(own, "id", "left").select("id", pad_sequence(ids, length).alias("seq"))
