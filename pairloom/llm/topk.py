"""Exact top-k by inner product, with a table of distances to pivots.

Vectors are whole numbers, floor(``SCALE`` * x). One more coordinate, sqrt(M^2 - |x|^2) for rows (M the
largest norm) and 0 for queries, makes the inner product fall with the distance. ``PIVOTS`` pivots lie
far apart: each is the farthest from those before it, out of ``SAMPLE`` rows of smallest hash (a bounded
sample; any pivots give exact results). The table holds each row's distances to all pivots; by the
triangle inequality the largest difference between the query's and the row's bounds their distance from
below, and so their score from above.

Rows lie in blocks of one nearest pivot, a common vector's copies in as many blocks as they need. A block
first gives the queries in it a threshold, the k-th best score there. Queries then go, in chunks of about
``CHUNK`` (a broadcast of some 20 MB whatever the table), past all blocks, and rows stay where they are:
a whole block is discarded where its ranges of distances lie beyond a query's threshold; of the others
each query takes candidates in order of their bound, ``STEP`` at a time, until the bound falls below the
k-th best score so far, which it carries from block to block within a task. The best k of each task are
merged. Work grows with queries times rows, as a share of all rows asks about all rows.

Each row is a candidate and, where asked, a query of its own, also if others have its vec_id; only the
query's own row is no candidate. Vectors that are null, empty or hold a null or non-finite component take
no part, nor do rows without vec_id; queries are compared with rows of their own dimension. Ties go to
the smaller vec_id. Components must stay below 2^53 in all sums. No other column is looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SCALE, PIVOTS, SAMPLE, STEP = 256, 64, 2048, 256
BLOCK_ROWS, CHUNK, _ABREAST = 2048, 32_768, 256
#: What single precision and square roots may lose of a distance.
_SLACK = 1e-5


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0.0))


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(most - (x * x).sum(axis=1), 0.0))[:, None]])


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of x, each the farthest from those before; fewer if the rest are repeats."""
    picked, near = [0], _apart(x, x[:1])[:, 0]
    while len(picked) < n and near.max() > 0:
        picked.append(int(near.argmax()))
        near = np.minimum(near, _apart(x, x[picked[-1:]])[:, 0])
    return x[picked]


def _celled(pivots: dict[int, np.ndarray], norms: dict[int, float]):
    """Adds the number of each row's nearest pivot."""

    def run(batches):
        for batch in batches:
            dims, cell = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims):
                on, d = np.flatnonzero(dims == dim), int(dim)
                x = _matrix(batch.column("v").take(pa.array(on)), d)
                cell[on] = _apart(_lifted(x, norms[d]), pivots[d]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    return run


def _packed(pivots: dict[int, np.ndarray], norms: dict[int, float], k: int):
    """A block as one row: its vectors with their distances to the pivots, and those of them that are queries, with thresholds."""

    def run(rows: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        rows = rows.sort_by("row_id").combine_chunks()
        key, ids, query = (C.column(rows, c).to_numpy(zero_copy_only=False) for c in ("row_id", "vec_id", "query"))
        x, most, p = _matrix(C.column(rows, "v"), dim), norms[dim], pivots[dim]
        far = _apart(_lifted(x, most), p).astype(np.float32)
        q = np.flatnonzero(query)
        asked = x[q]
        q_far = _apart(np.hstack([asked, np.zeros((len(q), 1))]), p).astype(np.float32)
        s = asked @ x.T
        s[np.arange(len(q)), q] = -np.inf
        least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(q), -np.inf)
        block = C.pack(key, ids.astype(np.int64), x.ravel(), far.ravel())
        return pa.table({"dim": pa.array([dim], pa.int32()), "place": pa.array([int(key[0])], pa.int64()), "asking": pa.array([len(q)], pa.int64()), "payload": pa.array([block], pa.binary()), "queries": pa.array([C.pack(key[q], ids[q].astype(np.int64), asked.ravel(), q_far.ravel(), least)], pa.binary())})

    return run


class _Queries:
    """Some queries of one dimension, and what a task has found for them."""

    def __init__(self, blobs: list[bytes], dim: int, k: int):
        key, ids, x, far, least = (np.concatenate(c) for c in zip(*map(C.unpack, blobs), strict=True))
        self.key, self.ids, self.x, self.far, self.least, self.k = key, ids, x.reshape(-1, dim), far.reshape(len(key), -1), least, k

    def __len__(self) -> int:
        return len(self.key)

    def start(self) -> None:
        self.score, self.found = np.full((len(self), self.k), -np.inf), np.zeros((len(self), self.k), np.int64)
        self.evaluated = np.zeros(len(self), np.int64)

    def reach(self, i, most: float) -> np.ndarray:
        """The largest distance at which a row can be among the k best."""
        least = np.maximum(self.least[i], self.score[i, -1])
        size = (self.x[i] * self.x[i]).sum(axis=-1) + most
        return np.sqrt(np.maximum(size - 2 * least, 0.0)) * (1 + _SLACK) + _SLACK * np.sqrt(size)

    def visit(self, block: bytes, most: float) -> None:
        key, ids, x, far = C.unpack(block)
        x, far = x.reshape(len(key), -1), far.reshape(len(key), -1)
        lo, hi, columns = far.min(axis=0), far.max(axis=0), np.ascontiguousarray(far.T)
        for at in range(0, len(self), _ABREAST):
            few = np.arange(at, min(at + _ABREAST, len(self)))
            beyond = np.maximum(lo - self.far[few], self.far[few] - hi).max(axis=1)
            few = few[beyond <= self.reach(few, most)]
            if len(few):
                apart = np.zeros((len(few), len(key)), np.float32)
                for p, column in enumerate(columns):
                    np.maximum(apart, np.abs(self.far[few, p, None] - column), out=apart)
                for i, bound in zip(few, apart, strict=True):
                    self.evaluate(i, bound, key, ids, x, most)

    def evaluate(self, i: int, bound: np.ndarray, key: np.ndarray, ids: np.ndarray, x: np.ndarray, most: float) -> None:
        near = np.flatnonzero((bound <= self.reach(i, most)) & (key != self.key[i]))
        near = near[np.argsort(bound[near], kind="stable")]
        for lo in range(0, len(near), STEP):
            if bound[near[lo]] > self.reach(i, most):
                break
            some = near[lo : lo + STEP]
            s = x[some] @ self.x[i]
            self.evaluated[i] += len(some)
            good = np.flatnonzero(s >= max(self.score[i, -1], self.least[i]))
            if len(good):
                s, v = np.concatenate((self.score[i], s[good])), np.concatenate((self.found[i], ids[some[good]]))
                top = np.lexsort((v, -s))[: self.k]
                self.score[i], self.found[i] = s[top], v[top]

    def results(self) -> pa.RecordBatch:
        """A row per result, and one without for the rows evaluated."""
        q, r = np.nonzero(self.score > -np.inf)
        n = len(self)
        none = pa.nulls(n, pa.int64())
        cut = lambda a, b: pa.concat_arrays([pa.array(a, pa.int64()), b])
        return pa.RecordBatch.from_pydict({
            "row_id": cut(self.key[q], pa.array(self.key)),
            "query_id": cut(self.ids[q], pa.array(self.ids)),
            "vec_id": cut(self.found[q, r], none),
            "score": cut(self.score[q, r].astype(np.int64), none),
            "evaluated": cut(np.zeros(len(q), np.int64), pa.array(self.evaluated)),
        })


def _pass(asked, norms: dict[int, float]):
    """The chunk's queries past the blocks of one task."""

    def run(batches):
        own = asked.value
        for q in own.values():
            q.start()
        for batch in batches:
            for dim, block in zip(batch.column("dim").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if dim in own:
                    own[dim].visit(block, norms[dim])
        for q in own.values():
            yield q.results()

    return run


def search(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """(row_id, query_id, rank, vec_id, score, evaluated) for the rows that ``queries`` holds for, against all rows of (vec_id, embedding).

    row_id tells queries of one vec_id apart; evaluated is the number of rows whose score was computed for a query.
    """
    spark = vectors.sparkSession
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * SCALE).cast("double"))
    fine = F.forall(F.col("embedding").cast("array<double>"), lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL").filter(fine).filter(F.size("embedding") > 0)
    rows = rows.select("vec_id", v.alias("v"), F.coalesce(queries, F.lit(False)).alias("query"), F.size("embedding").alias("dim"))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0d, (s, x) -> s + x * x)")).alias("m"), F.count_if("query").alias("q")).collect()  # a row per dimension
    norms, pivots = {r.dim: float(r.m) for r in sizes}, {}
    for r in sizes:
        got = rows.filter(F.col("dim") == r.dim).orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").select("v").limit(SAMPLE).collect()
        pivots[r.dim] = far_apart(_lifted(np.array([x.v for x in got]), norms[r.dim]), PIVOTS)
    numbered = rows.select(F.monotonically_increasing_id().alias("row_id"), "*")
    kinds = "row_id long, vec_id long, v array<double>, query boolean, dim int"
    celled = C.materialize(numbered.select("row_id", F.col("vec_id").cast("long"), "v", "query", "dim").mapInArrow(_celled(pivots, norms), f"{kinds}, cell int"))
    share = celled.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", F.ceil(F.col("n") / BLOCK_ROWS).alias("parts"))  # a row per pivot
    placed = celled.join(F.broadcast(share), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")))
    packed = placed.select("dim", "cell", "part", "row_id", "vec_id", "v", "query").groupBy("dim", "cell", "part").applyInArrow(_packed(pivots, norms, k), "dim int, place long, asking long, payload binary, queries binary")
    blocks = C.materialize(packed)
    chunks = max(1, -(-sum(r.q for r in sizes) // CHUNK))
    found = C.scratch(spark)
    schema = "row_id long, query_id long, vec_id long, score long, evaluated long"
    for c in range(chunks):
        chunk = blocks.filter("asking > 0").filter(F.pmod(F.xxhash64("place"), F.lit(chunks)) == c).select("dim", "queries").collect()  # about CHUNK queries
        by: dict[int, list[bytes]] = {}
        for r in chunk:
            by.setdefault(r.dim, []).append(r.queries)
        asked = spark.sparkContext.broadcast({dim: _Queries(blobs, dim, k) for dim, blobs in by.items()})
        blocks.select("dim", "payload").mapInArrow(_pass(asked, norms), schema).write.parquet(f"{found}/chunk={c}")
        asked.unpersist()
    got = spark.read.schema(schema).parquet(found)
    rank = F.expr("row_number() OVER (PARTITION BY row_id ORDER BY score DESC NULLS LAST, vec_id)")
    got = got.withColumn("rank", rank).withColumn("evaluated", F.expr("sum(evaluated) OVER (PARTITION BY row_id)"))
    return got.filter((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("row_id", "query_id", "rank", "vec_id", "score", "evaluated")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score")


SQL = {
    "op8_topk_search": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.r <> q.r AND len(c.e) = len(q.e)
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
""",
}
