"""Mixing of sources: temperature weights, realised as budgeted permutations of each source's blocks.

A source's token share p is raised to an exponent a and normalised. a lies between 0 and 1, the smaller
the more even the weights, and is found by bisection: the smallest exponent at which no source is
repeated more than ``REPEATS`` times as often as the least repeated one, or at which the weights' entropy
does not exceed a target (``entropy``, in nats). The budget is the smallest at which every source is used
once, unless one is given. Sources stay a table throughout; the driver sees sums over them only.

Each source has a budget of tokens, its weight of the whole. Its rows lie in a fixed permutation: by
block, the first bits of a hash of doc_id and text, then by that hash (``key``). Whole passes over the
source come first; of the last pass those rows are taken whose tokens end within what is left. Sums by
block settle which blocks are whole, and only the one block in which the budget ends is looked into row
by row. Blocks hold about ``BLOCK_TOKENS`` tokens, so a source with a third of all rows has many.
``place``, from 0 to 1, says where in its source's share of the mix a row stands: in order of it, all
sources are mixed at their weights throughout.

Tokens are the words of a text (none if null). A null source is a source of its own. Sources without
tokens are passed through once. Rows that are equal share their fate. Extra columns pass through. An
empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

REPEATS, BLOCK_TOKENS = 1.25, 20_000
_STEPS, _ABREAST = 60, 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _bisected(meets) -> float:
    """The smallest exponent from 0 to 1 that meets a condition which holds from some exponent on, and at 1."""
    if meets(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(_STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if meets(mid) else (mid, hi)
    return hi


def _even_enough(share: DataFrame, entropy: float) -> float:
    """As _bisected, for a limit on the entropy; each look at the table tries _ABREAST exponents."""
    lo, hi, p = 0.0, 1.0, F.col("p")
    while hi - lo > 2.0**-_STEPS and hi - lo > math.ulp(hi):
        tried = [lo + (hi - lo) * k / (_ABREAST - 1) for k in range(_ABREAST)]
        sums = share.agg(*(x for a in tried for x in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p))))).first()
        good = [k for k, a in enumerate(tried) if math.log(sums[2 * k]) - a * sums[2 * k + 1] / sums[2 * k] <= entropy]
        if not good:
            return 1.0
        if good[0] == 0:
            return lo
        lo, hi = tried[good[0] - 1], tried[good[0]]
    return hi


def weights(totals: DataFrame, repeats: float = REPEATS, entropy: float | None = None) -> tuple[float, DataFrame]:
    """The exponent, and (source, tokens, weight) of (source, tokens): weight 0 without tokens."""
    whole, least, most = totals.filter("tokens > 0").agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not whole:
        return 1.0, totals.withColumn("weight", F.lit(0.0))
    p = F.col("tokens") / F.lit(float(whole))
    share = totals.filter("tokens > 0").select(p.alias("p"))
    # a source is used in proportion to tokens^(a - 1), so the smallest and the largest source are furthest apart
    a = _even_enough(share, entropy) if entropy is not None else _bisected(lambda a: (most / least) ** (1 - a) <= repeats)
    total = share.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    return a, totals.withColumn("weight", F.when(F.col("tokens") > 0, F.pow(p, F.lit(a)) / total).otherwise(0.0))


def plan(totals: DataFrame, repeats: float = REPEATS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """(source, tokens, weight, passes, rest): whole passes over a source, and tokens of its last pass."""
    weighed = C.materialize(weights(totals, repeats, entropy)[1])
    if budget is None:
        budget = weighed.agg(F.max(F.try_divide(F.col("tokens").cast("double"), F.col("weight")))).first()[0] or 0.0
    own = F.floor(F.lit(float(budget)) * F.col("weight") + 1e-6).cast("long")
    some = F.col("tokens") > 0
    passes, rest = F.when(some, F.floor(F.try_divide(own, F.col("tokens")))).otherwise(1), F.when(some, F.try_mod(own, F.col("tokens"))).otherwise(0)
    return weighed.select("*", passes.cast("int").alias("passes"), rest.cast("long").alias("rest"))


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def mix(docs: DataFrame, repeats: float = REPEATS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """The rows of docs, each as often as the mix has it, as (row, copy, block, key, place): the struct of the input's columns, and the pass from 0."""
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns))
    source = F.col("source").cast("string").alias("source")
    slim = C.materialize(docs.select(source, n_words(F.col("text")).alias("n_tokens"), _key().alias("key")))
    return _mixed(docs.select(row.alias("row"), source, _key().alias("key")), slim, repeats, entropy, budget).select("row", "copy", "block", "key", "place")


def _mixed(rows: DataFrame, slim: DataFrame, repeats: float, entropy: float | None, budget: float | None) -> DataFrame:
    """rows: (source, key, ...); slim: (source, n_tokens, key) of the same rows, from which everything is decided."""
    totals = C.materialize(slim.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    told = C.materialize(plan(totals, repeats, entropy, budget).withColumnRenamed("source", "of"))
    # blocks: the leading bits of the hash, more of them for a larger source
    bits = F.least(F.greatest(F.ceil(F.log2(F.greatest(F.col("tokens"), F.lit(1)) / BLOCK_TOKENS)), F.lit(0)), F.lit(32)).cast("int")
    part = F.expr("shiftrightunsigned(key, 1)") / F.lit(2.0**63)  # of all keys, in [0, 1)
    block = F.floor(part * F.pow(F.lit(2.0), bits)).cast("long")
    with_block = lambda df: df.join(told, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", block)
    blocks = C.materialize(with_block(slim).groupBy("source", "block", "rest").agg(F.sum("n_tokens").alias("n")))
    # running sums over blocks, by stretches of 256 blocks first
    reach = F.floor(F.col("block") / 256)
    upto = lambda c, part, order: F.coalesce(F.expr(f"sum({c}) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))
    far = blocks.groupBy("source", reach.alias("reach")).agg(F.sum("n").alias("n")).select("source", "reach", upto("n", "source", "reach").alias("before"))
    near = blocks.withColumn("reach", reach).withColumn("inside", upto("n", "source, reach", "block"))
    j = (near.source.eqNullSafe(far.source)) & (near.reach == far.reach)
    ends = near.join(far, j).select(near.source, "block", "n", "rest", (F.col("before") + F.col("inside")).alias("start"))
    state = F.when(F.col("start") + F.col("n") <= F.col("rest"), 1).when(F.col("start") < F.col("rest"), 2).otherwise(0)
    ends = C.materialize(ends.select(F.col("source").alias("s"), F.col("block").alias("b"), "start", state.alias("state")).filter("state > 0"))
    # the block where a source's budget ends, row by row
    edge = ends.filter("state = 2")
    inside = with_block(slim).join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).groupBy("source", "block", "rest", "start", "key").agg(F.sum("n_tokens").alias("n"))
    upto_key = F.col("start") + F.expr("sum(n) OVER (PARTITION BY source, block ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    last = C.materialize(inside.withColumn("end", upto_key).filter("end <= rest").groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.max("key").alias("last")))
    ends = C.materialize(ends.join(last.withColumnRenamed("s", "s2").withColumnRenamed("b", "b2"), F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2")), "left").select("s", "b", "state", "last"))
    got = with_block(rows).join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    extra = F.when(F.col("state") == 1, 1).when((F.col("state") == 2) & (F.col("key") <= F.col("last")), 1).otherwise(0)
    times = (F.col("passes") + F.coalesce(extra, F.lit(0))).cast("int")
    used = F.greatest(F.col("passes") + F.coalesce(F.try_divide(F.col("rest").cast("double"), F.col("tokens")), F.lit(0.0)), F.lit(1.0))
    out = got.withColumn("times", times).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return out.withColumn("place", F.least((F.col("copy") + part) / used, F.lit(1.0)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    rows = C.materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("n_tokens"), _key().alias("key")))
    return _mixed(rows, rows, REPEATS, None, None).select("doc_id", "source", "n_tokens", "copy", "weight", "block", "key", "place")


SQL: dict[str, str] = {}
