"""Near-duplicate groups of documents by MinHash with tensored banding, all links confirmed on full sets.

A document's set holds the distinct runs of ``width`` words (A-Z lower-cased); with fewer words the
whole sequence is the one element, without words the set is empty and linked with nothing. Two
documents are linked if their sets' intersection is at least ``num``/``den`` of their union.

Tensoring: two collections of ``HALVES`` half-keys, each of ``EACH`` MinHash values, give
HALVES * HALVES table keys of 2 * EACH values by pairing any half-key of the one with any of the other,
for the cost of 2 * HALVES * EACH MinHash values. A pair of similarity s is missed only if no half-key
of one collection is shared: 2 * (1 - s^EACH)^HALVES at most, which is 7e-5 at 0.85 and 5e-4 at 0.8,
and far less within a group, where other links tie the same documents.

Documents with equal sets form one class, and from then on its smallest doc_id stands for it. Half-keys
that only one class has are dropped before keys are paired. In each round every class is compared with
one other of its buckets, by sets, and linked classes merge; buckets within one group are done. After
``STARS`` rounds the buckets that still hold several groups are settled in whole: buckets of up to
``SMALL`` classes list their pairs of different groups, larger ones compare them in tiles of ``TILE``
elements, each pair in the first bucket that it shares only. A sketch of ``BINS`` bins (the first
element of each) passes a pair on to the full sets unless its estimate lies more than ``DEVIATIONS``
standard deviations below the threshold, which a true link does with a chance of some 1e-6. No pair
within a group is listed.

Elements are 52-bit fingerprints of words; two elements of one pair of documents of 1,000 words share
one with a chance of 1e-10. Null and empty texts have an empty set; rows with one doc_id are each
treated by their own text, and equal rows get equal results. No other column is looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components

HALVES, EACH, STARS = 8, 2, 2
SMALL, BINS, DEVIATIONS = 24, 256, 5
#: Elements of the sets in a tile, and its classes, about.
TILE, TILE_ROWS = 1_000_000, 4096
_SLOTS = [f"h{i}" for i in range(2 * HALVES)]
_BITS = np.uint64(52)
_SLICE_BYTES, _SLICE_ROWS = 4 << 20, 4000


def slices(batch: pa.RecordBatch, text: str = "text"):
    """The batch in parts of a few megabytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total, lo = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and (total + n > _SLICE_BYTES or i - lo >= _SLICE_ROWS):
            yield batch.slice(lo, i - lo)
            total, lo = 0, i
        total += int(n)
    if lo < batch.num_rows:
        yield batch.slice(lo)


def sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements of each row's set, ascending, row after row: (elements, number in each row)."""
    w = C.Words(texts, lower=True)
    grams = w.grams(width, 11)
    at = np.flatnonzero(w.pos + width <= w.count[w.doc])
    doc, got = [w.doc[at]], [grams[at]]
    for n in range(1, width):
        short = np.flatnonzero(w.count == n)
        if len(short):
            doc.append(short)
            got.append(w.grams(n, 5000 + n)[w.first[short]])
    key = (np.concatenate(doc).astype(np.uint64) << _BITS) | (C.mix(np.concatenate(got)) >> (np.uint64(64) - _BITS))
    key = np.unique(key)
    return key & ((np.uint64(1) << _BITS) - np.uint64(1)), np.bincount((key >> _BITS).astype(np.int64), minlength=len(texts))


def _per_row(op, values: np.ndarray, count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        out[full] = op.reduceat(values, np.concatenate(([0], np.cumsum(count[full])[:-1])))
    return out


def _sketch(width: int):
    def run(batches):
        rng = np.random.default_rng(20240229)
        odd = rng.integers(0, 2**63, 2 * HALVES * EACH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        xor = rng.integers(0, 2**63, 2 * HALVES * EACH, dtype=np.uint64)
        for batch in batches:
            for part in slices(batch):
                got, count = sets(part.column("text"), width)
                full = C.mix(got + np.uint64(1))
                out = {"doc_id": part.column("doc_id"), "n_shingles": pa.array(count, pa.int64())}
                for name, salt in (("hi", 3), ("lo", 71)):
                    out[name] = pa.array(_per_row(np.add, C.mix(full + np.uint64(salt)), count).view(np.int64))
                for s, name in enumerate(_SLOTS):
                    half = np.zeros(len(count), np.uint64)
                    for k in range(s * EACH, (s + 1) * EACH):
                        v = (full ^ xor[k]) * odd[k]
                        v ^= v >> np.uint64(31)
                        half = C.join2(half, _per_row(np.minimum, v, count), k)
                    out[name] = pa.array(half.view(np.int64))
                yield pa.RecordBatch.from_pydict(out)

    return run


def _sketches(got: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A row of BINS bytes for each set: 0 for a bin without elements, else 1 to 255 from its first element."""
    doc, place = np.repeat(np.arange(len(count)), count), (got >> (_BITS - np.uint64(8))).astype(np.int64)
    new = np.ones(len(got), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    out = np.zeros((len(count), BINS), np.uint8)
    out[doc[new], place[new]] = got[new] % np.uint64(255) + np.uint64(1)
    return out


def _near(a: np.ndarray, b: np.ndarray, limit: float, elements: np.ndarray) -> np.ndarray:
    """Whether the sketches in the rows of a are near those in b (or the one b). elements: of both sets together.

    The bins seen are drawn out of the union, all of it if the sets are small, without putting any back.
    """
    seen = ((a > 0) | (b > 0)).sum(axis=-1)
    same = ((a == b) & (a > 0)).sum(axis=-1)
    union = np.maximum(elements / (1 + limit), 2.0)  # of sets that are just alike enough; those more alike have a smaller one
    left = np.clip((union - seen) / (union - 1), 0.0, 1.0)
    return same >= seen * limit - DEVIATIONS * np.sqrt(np.maximum(seen, 1) * limit * (1 - limit) * left) - 1


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                got, count = sets(part.column("text"), width)
                raw, end = got.tobytes(), 8 * np.cumsum(count)
                blobs = [raw[e - 8 * n : e] for e, n in zip(end.tolist(), count.tolist(), strict=True)]
                short = [x.tobytes() for x in _sketches(got, count)]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "elements": pa.array(blobs, pa.binary()), "sketch": pa.array(short, pa.binary()), "size": pa.array(count, pa.int64())})

    return run


def _likely(num: int, den: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                u, v = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("u_sketch", "v_sketch"))
                batch = batch.filter(pa.array(_near(u, v, num / den, batch.column("elements").to_numpy())))
            yield batch.select(["u", "v"])

    return run


def _alike(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if min(len(a), len(b)) * den < max(len(a), len(b)) * num:
        return False
    both = np.concatenate((a, b))
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return den * shared >= num * (len(both) - shared)


def _confirmed(num: int, den: int):
    def run(batches):
        for batch in batches:
            u, v = batch.column("u_set").to_pylist(), batch.column("v_set").to_pylist()
            good = [_alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), num, den) for a, b in zip(u, v, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good))

    return run


def _tiles(num: int, den: int):
    """Links between the classes of two tiles of one bucket, where their groups differ."""

    def run(rows: pa.Table) -> pa.Table:
        ids, side, root, n = (rows.column(c).to_numpy() for c in ("rep", "side", "root", "size"))
        slots = np.stack([rows.column(c).to_numpy() for c in _SLOTS], axis=1)
        a, b, one = (rows.column(c)[0].as_py() for c in ("a", "b", "one"))
        own = rows.column("elements").to_pylist()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
        group = {int(r): int(r) for r in np.unique(root)}

        def top(x: int) -> int:
            while group[x] != x:
                group[x] = group[group[x]]
                x = group[x]
            return x

        found = []
        everyone, right_side = np.arange(len(ids)), np.flatnonzero(side == 1)
        for i in everyone if one else np.flatnonzero(side == 0):
            right = everyone[i + 1 :] if one else right_side
            right = right[(root[right] != root[i]) & (np.minimum(n[right], n[i]) * den >= np.maximum(n[right], n[i]) * num)]
            agree = slots[right] == slots[i]
            right = right[(agree[:, :HALVES].argmax(axis=1) == a) & (agree[:, HALVES:].argmax(axis=1) + HALVES == b)]
            for j in right[_near(sketch[right], sketch[i], num / den, n[right] + n[i])]:
                x, y = top(int(root[i])), top(int(root[j]))
                if x != y and _alike(np.frombuffer(own[i], np.uint64), np.frombuffer(own[j], np.uint64), num, den):
                    group[max(x, y)] = min(x, y)
                    found.append((int(ids[i]), int(ids[j])))
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def near_groups(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """A row per input row: doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, n_shingles long, hi long, lo long, " + ", ".join(f"{s} long" for s in _SLOTS)
    rows = C.materialize(slim.mapInArrow(_sketch(width), kinds))
    same = ["n_shingles", "hi", "lo"]
    classes = C.materialize(rows.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), *(F.first(s).alias(s) for s in _SLOTS)))

    # half-keys that several classes have, and the tables' keys made of them
    halves = classes.select("rep", F.posexplode(F.array(*_SLOTS)).alias("slot", "half"))
    common = C.materialize(halves.groupBy("slot", "half").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    shared = halves.join(common, ["slot", "half"], "left_semi").groupBy("rep").agg(F.collect_list(F.struct("slot", "half")).alias("s"))
    pick = lambda first: F.filter("s", lambda x: (x.slot < HALVES) if first else (x.slot >= HALVES))
    keys = (
        shared.select("rep", F.explode(pick(True)).alias("a"), pick(False).alias("bs"))
        .select("rep", "a", F.explode("bs").alias("b"))
        .select("rep", F.xxhash64("a.slot", "a.half", "b.slot", "b.half").alias("key"), F.col("a.slot").alias("a"), F.col("b.slot").alias("b"))
    )
    keys = C.materialize(keys)
    several = C.materialize(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("least")).filter("n > 1").select("key", "least"))
    buckets = C.materialize(keys.join(several.select("key"), "key", "left_semi").join(classes.select("rep", "n_shingles"), "rep"))
    involved = buckets.select("rep").distinct()
    full = C.materialize(slim.join(involved, slim.doc_id == involved.rep, "left_semi").mapInArrow(_full_sets(width), "doc_id long, elements binary, sketch binary, size long"))

    def confirm(pairs: DataFrame) -> DataFrame:
        u, v = (full.select(F.col("doc_id").alias(c), F.col("elements").alias(f"{c}_set")) for c in "uv")
        return pairs.join(u, "u").join(v, "v").select("u", "v", "u_set", "v_set").mapInArrow(_confirmed(num, den), "u long, v long")

    links, roots, open_ = None, None, buckets.withColumn("root", F.col("rep"))
    for k in range(STARS):
        # the group of each bucket's hub, and for each class one hub of another group
        hub = open_.groupBy("key").agg(F.min(F.struct((F.col("rep") if k == 0 else F.xxhash64("rep", F.lit(k))).alias("o"), "rep", "root")).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        hub = C.materialize(hub.select("key", F.col("hub.rep").alias("v"), F.col("hub.root").alias("v_root")))
        pairs = open_.join(hub, "key").filter("root <> v_root").groupBy(F.col("rep").alias("u")).agg(F.min("v").alias("v"))
        found = C.materialize(confirm(C.materialize(pairs)))
        links = found if links is None else C.materialize(links.unionByName(found))
        roots = components(links)
        labelled = buckets.join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        open_ = C.materialize(labelled)
        left = C.materialize(open_.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("elements_n")).filter("lo < hi"))
        if left.isEmpty():
            break
        open_ = C.materialize(open_.join(left.select("key", "n", "elements_n"), "key"))
    if not left.isEmpty():
        few, many = open_.filter(F.col("n") <= SMALL), open_.filter(F.col("n") > SMALL)
        u, v = (few.select("key", F.col("rep").alias(c), F.col("root").alias(f"{c}_root")) for c in "uv")
        pairs = u.join(v, "key").filter("u < v AND u_root <> v_root").select("u", "v").distinct()
        u, v = (full.select(F.col("doc_id").alias(c), F.col("sketch").alias(f"{c}_sketch"), F.col("size").alias(f"{c}_n")) for c in "uv")
        pairs = pairs.join(u, "u").join(v, "v").filter(f"least(u_n, v_n) * {den} >= greatest(u_n, v_n) * {num}")
        likely = C.materialize(pairs.select("u", "v", "u_sketch", "v_sketch", (F.col("u_n") + F.col("v_n")).alias("elements")).mapInArrow(_likely(num, den), "u long, v long"))
        # tiles of a larger bucket: each class meets every tile of its bucket once
        tiles = F.greatest(F.ceil(F.col("elements_n") / TILE), F.ceil(F.col("n") / TILE_ROWS))
        placed = many.select("key", "a", "b", "rep", "root", F.pmod(F.xxhash64("rep", F.lit(9)), tiles).alias("tile"), tiles.alias("tiles"))
        meets = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other"))
        meets = meets.select("key", "a", "b", "rep", "root", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("side"), (F.col("tile") == F.col("other")).alias("one"))
        meets = meets.join(classes.select("rep", *_SLOTS), "rep").join(full.withColumnRenamed("doc_id", "rep"), "rep")
        more = meets.groupBy("key", "i", "j").applyInArrow(_tiles(num, den), "u long, v long")
        links = C.materialize(links.unionByName(confirm(likely)).unionByName(more))
        roots = components(links)
    told = C.materialize(classes.select(*same, "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("root", "rep").alias("component_id")))
    return rows.select("doc_id", *same).join(told, same, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(C.table(spark, sf_dir, "documents"), width=3, num=85, den=100).withColumn("kept", F.col("doc_id") == F.col("component_id"))


SQL = {
    "op7_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(list_slice(ws, i, i + 2), ' '))) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), pairs AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM s
  UNION
  SELECT p.v, reach.r FROM reach JOIN pairs p ON p.u = reach.doc_id
), c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
""",
}
