"""Sharding by extendible hashing: only buckets over the byte limit split, on one more bit of the hash.

The hash is the first 60 bits of md5 of the doc_id as text. Bucket and hash prefix are one thing: a
shard of depth d holds the rows whose first d bits are its ``prefix``. The directory is found in
rounds of ``BITS`` bits: bytes are summed by the prefix that ends the round, and of a bucket's
prefixes the shortest that fits the limit becomes a shard; rows of those that never fit go on to the
next round. Only sums by prefix are shuffled until all fit, then the rows meet their directory entry.

Rows that share all 60 bits (one doc_id, or a null one) cannot be told apart by bits: if they alone are
over the limit, as is a single row of more bytes, they form one shard of depth 60, or, for a single
hash in its bucket, of the depth where it stands alone, marked ``oversize``. Texts count their UTF-8
bytes, null ones 0. Equal rows share a shard. No other column is looked at. An empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

HASH_BITS, BITS = 60, 6
LIMIT = 1 << 20


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row per input row: doc_id, n_bytes, depth, prefix (the shard's bits as a number), shard_id ('depth-prefix'), oversize."""
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), h.alias("h"))
    rows = C.materialize(rows)
    # bytes by hash, so that one id with a third of all rows is one number from here on
    sums = C.materialize(rows.groupBy("h").agg(F.sum("n_bytes").alias("bytes")))
    left, known, depth = sums.withColumn("bucket", F.lit(0).cast("long")), None, 0
    while depth < HASH_BITS:
        last = depth + BITS >= HASH_BITS
        end = min(depth + BITS, HASH_BITS)
        ends = left.groupBy("bucket", F.shiftright("h", HASH_BITS - end).alias("e")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        levels = []
        for d in range(depth, end + 1):  # a bucket has 2^BITS ends at most
            p = F.shiftright("e", end - d)
            over = lambda f, c: f"{f}({c}) OVER (PARTITION BY bucket, shiftright(e, {end - d}))"  # noqa: B023, E731
            total, one = F.expr(over("sum", "bytes")), F.expr(f"{over('min', 'lo')} = {over('max', 'hi')}")
            fits = (total <= limit) | one | (F.lit(d) >= HASH_BITS)
            levels.append(F.when(fits, F.struct(F.lit(d).alias("depth"), p.alias("prefix"), (total > limit).alias("oversize"))))
        ends = C.materialize(ends.repartition("bucket").select("bucket", "e", F.coalesce(*levels).alias("shard")))
        done = ends.filter("shard IS NOT NULL").select(F.lit(end).alias("round"), "e", "shard.depth", "shard.prefix", "shard.oversize")
        known = done if known is None else known.unionByName(done)
        open_ = ends.filter("shard IS NULL").select("e")
        if last or open_.isEmpty():
            break
        e = F.shiftright("h", HASH_BITS - end)
        left = C.materialize(left.drop("bucket").withColumn("bucket", e).join(open_.select(F.col("e").alias("bucket")), "bucket", "left_semi").select("h", "bytes", "bucket"))
        depth = end
    # each hash meets the entry of the round in which its bucket came to fit
    known = C.materialize(known)
    rounds = [r[0] for r in known.select("round").distinct().collect()]  # ten at most
    probe = sums.select("h", F.explode(F.array(*(F.struct(F.lit(r).alias("round"), F.shiftright("h", HASH_BITS - r).alias("e")) for r in rounds))).alias("x")) if rounds else sums.select("h").withColumn("x", F.struct(F.lit(0).alias("round"), F.col("h").alias("e"))).limit(0)
    found = C.materialize(probe.select("h", "x.*").join(known, ["round", "e"]).select("h", "depth", "prefix", "oversize"))
    out = rows.join(found, "h")
    return out.select("doc_id", "n_bytes", "depth", "prefix", F.concat_ws("-", "depth", "prefix").alias("shard_id"), "oversize")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(C.table(spark, sf_dir, "documents"))


SQL = {
    "op2_sharding": f"""
WITH d AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents
), p AS (
  SELECT doc_id, n_bytes, k AS depth, h >> ({HASH_BITS} - k) AS prefix,
         sum(n_bytes) OVER (PARTITION BY k, h >> ({HASH_BITS} - k)) AS total,
         min(h) OVER (PARTITION BY k, h >> ({HASH_BITS} - k)) = max(h) OVER (PARTITION BY k, h >> ({HASH_BITS} - k)) AS one
  FROM d, (SELECT unnest(range(0, {HASH_BITS} + 1)) AS k)
), f AS (
  SELECT * FROM p WHERE total <= {LIMIT} OR one OR depth = {HASH_BITS}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
)
SELECT doc_id, n_bytes, depth::INTEGER AS depth, prefix::BIGINT AS prefix, depth || '-' || prefix AS shard_id, total > {LIMIT} AS oversize FROM f
""",
}
