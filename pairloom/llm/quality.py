"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over the bytes of the UTF-8 text, ``ORDER`` at a time (texts start with ORDER - 1 start
marks, byte 1); words of running text are too rare for counts of word runs to say much. Trusted are the
documents labelled of good quality and not toxic. All n-grams that the corpus asks for are scored, and
all text of the trusted documents is counted but for those held out (below); nothing is sampled.

Counts and scores are sharded: blocks of documents send their distinct n-grams, each once, with counts
where the text is trusted, to buckets of n-grams; buckets add up. N-grams of one context share a bucket,
so that the steps between a bucket's n-grams are small and travel in few bytes. Lower orders count distinct left extensions.
Discounts D1, D2, D3+ of an order follow from its numbers of n-grams seen once to four times. Joins by
n-gram, by context and by suffix, from order 1 up, give the probability of each n-gram asked for; the
buckets answer the blocks, and a block adds up its documents.

A document is rejected if its perplexity lies above an upper or below a lower quantile of trusted
documents of its language; languages without trusted documents use the quantiles over all. A model
knows its own text too well, so one trusted document in ``FOLDS``, by hash of its id, is not counted,
and the upper quantiles are those of these documents. Which quantiles, of ``UPPERS`` and ``LOWERS``, is
chosen by the labels: those that decide most labelled documents rightly, where the held-out share
stands for all trusted ones against the documents labelled bad or toxic, which are never counted.
Where none is labelled so, they are ``UPPER`` and ``LOWER``. Documents without text have no perplexity and are kept, as are all if nothing is
trusted. Rows that share a doc_id share labels; a row without one is never trusted. A byte 1 in a text reads
as a start mark. Other columns than doc_id, text and lang are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

ORDER = 5
UPPER, LOWER, FOLDS = 0.99, 0.002, 4
UPPERS, LOWERS = (1.0, 0.998, 0.995, 0.99, 0.985, 0.98, 0.97, 0.96, 0.95, 0.93, 0.9, 0.85, 0.8), (0.0, 0.002, 0.005, 0.01, 0.02)
LEAST = 0.05
_SENT = "bucket int, block int, keys binary, counts binary"


def _bucket(key, buckets):
    return (((key >> 8) * 0x5851F42D) >> 20) % buckets  # a context has 32 bits, its product 63


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams ending at each byte, row after row, and the number of bytes of each row."""
    raw = [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]
    start = b"\x01" * (ORDER - 1)
    buf = np.frombuffer(b"".join(y for x in raw for y in (start, x)) + start, np.uint8)
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    key = np.zeros(len(buf) - ORDER + 1, np.uint64)
    for k in range(ORDER):
        key |= buf[k : len(key) + k].astype(np.uint64) << np.uint64(8 * (ORDER - 1 - k))
    own = np.ones(len(key), bool)
    for at in np.cumsum(n + ORDER - 1)[:-1] if len(n) else ():
        own[at - ORDER + 1 : at] = False
    return key[: int((n + ORDER - 1).sum()) - ORDER + 1][own[: int((n + ORDER - 1).sum()) - ORDER + 1]] if len(n) else key[:0], n


def _dealt(keys: np.ndarray, buckets: int):
    b = _bucket(keys.astype(np.int64), buckets)
    order = np.argsort(b, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(b[order])) + 1) if len(order) else ():
        yield int(b[part[0]]), part


def _keys(blob: bytes) -> np.ndarray:
    return C.unpack_ascending(blob)[0]


def _ask(buckets: int):
    def run(rows: pa.Table, trusted: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(4)]
        if rows.num_rows:
            block = rows.column("block")[0].as_py()
            rows = C.unblocked(rows)
            keys, n = _grams(C.column(rows, "text"))
            good = pc.is_in(C.column(rows, "doc_id"), value_set=C.column(trusted, "doc_id").drop_null()).to_numpy(zero_copy_only=False)
            seen, count = np.unique(keys[np.repeat(good, n)], return_counts=True)
            asked = np.unique(keys)
            counts = np.zeros(len(asked), np.int64)
            counts[np.searchsorted(asked, seen)] = count
            found = [(b, block, C.pack_ascending(asked[p]), C.pack(C.planes(counts[p])) if counts[p].any() else None) for b, p in _dealt(asked, buckets)]
            out = [list(x) for x in zip(*found, strict=True)] or out
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "block", "keys", "counts"])

    return run


def _merged(rows: pa.Table) -> pa.Table:
    """A bucket's n-grams: how often trusted text has each."""
    keys, counts = [], []
    for k, c in zip(rows.column("keys").to_pylist(), rows.column("counts").to_pylist(), strict=True):
        keys.append(_keys(k))
        counts.append(C.numbers(C.unpack(c)[0]).astype(np.int64) if c else np.zeros(len(keys[-1]), np.int64))
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    return pa.table({"key": pa.array(key.astype(np.int64)), "n": pa.array(np.bincount(back, np.concatenate(counts), len(key)).astype(np.int64))})


def _answer(rows: pa.Table, scores: pa.Table) -> pa.Table:
    key, logp = scores.column("key").to_numpy(), scores.column("logp").to_numpy()
    order = np.argsort(key)
    key, logp = key[order].astype(np.uint64), logp[order].astype(np.float32)
    replies = [C.pack(C.planes(logp[np.searchsorted(key, _keys(x))].view(np.uint32))) for x in rows.column("keys").to_pylist()]
    return pa.table({"block": rows.column("block"), "bucket": rows.column("bucket"), "payload": pa.array(replies, pa.binary())})


def _score(buckets: int):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        rows = C.unblocked(rows)
        keys, n = _grams(C.column(rows, "text"))
        asked = np.unique(keys)
        told = dict(zip(replies.column("bucket").to_pylist(), replies.column("payload").to_pylist(), strict=True))
        logp = np.zeros(len(asked), np.float64)
        for b, p in _dealt(asked, buckets):
            logp[p] = C.numbers(C.unpack(told[b])[0]).astype(np.uint32).view(np.float32)
        end = np.cumsum(n)
        total = np.zeros(len(n))
        step = 1 << 20
        for lo in range(0, len(keys), step):  # in parts, for bounded memory
            part = logp[np.searchsorted(asked, keys[lo : lo + step])]
            total += np.bincount(np.searchsorted(end, np.arange(lo, lo + len(part)), side="right"), part, len(n))
        return pa.table({"doc_id": rows.column("doc_id"), "lang": rows.column("lang"), "n_bytes": pa.array(n), "log_likelihood": pa.array(total)})

    return run


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times, LEAST at least, so that every context leaves something; 0.5, 1 and 1.5 where some number is 0."""
    n = [x or 0 for x in counts.agg(*(F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4))).first()]
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], LEAST), float(k)) for k in (1, 2, 3)]


def _by(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).when(n >= 3, d[2]).otherwise(0.0)


def scores(grams: DataFrame) -> DataFrame:
    """(key, logp) for each key of (key, n): n-grams asked for, with their counts in trusted text."""
    counts = {ORDER: grams.filter("n > 0")}
    asked = {ORDER: grams.select("key")}
    for k in range(ORDER - 1, 0, -1):
        short = F.col("key").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("key")
        counts[k] = C.materialize(counts[k + 1].groupBy(short).agg(F.count("*").alias("n")))
        asked[k] = C.materialize(asked[k + 1].select(short).distinct())
    p: DataFrame | None = None
    for k in range(1, ORDER + 1):
        d = _discounts(counts[k])
        context = counts[k].groupBy(F.shiftright("key", 8).alias("context")).agg(F.sum("n").alias("total"), F.sum(_by(F.col("n"), d)).alias("left"))
        got = asked[k].join(counts[k], "key", "left").withColumn("context", F.shiftright("key", 8)).join(context, "context", "left")
        if p is None:
            got = got.withColumn("lower", F.lit(1 / 256))
        else:
            got = got.withColumn("short", F.col("key").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))).join(p, "short")
        own = F.coalesce((F.col("n") - _by(F.col("n"), d)) / F.col("total"), F.lit(0.0))
        rest = F.coalesce(F.col("left") / F.col("total"), F.lit(1.0))
        p = C.materialize(got.select(F.col("key").alias("short"), (own + rest * F.col("lower")).alias("lower")))
    return p.select(F.col("short").alias("key"), F.log("lower").alias("logp"))


def _held() -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(FOLDS)) == 0


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """A row per input row: doc_id, lang, n_bytes, perplexity, trusted. trusted: a column doc_id."""
    blocks = C.blocks_of(docs)
    buckets = max(C.partitions(docs.sparkSession), blocks // 2)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    block = C.blocked_tight(slim, ["doc_id", "text", "lang"], blocks)
    good = C.materialize(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    sent = C.materialize(block.groupBy("block").cogroup(C.blocked(good.filter(~_held()), ["doc_id"], blocks).groupBy("block")).applyInArrow(C.lean(_ask(buckets), 2), _SENT))
    grams = C.materialize(sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(C.lean(_merged, 1), "key long, n long"))
    place = F.pmod(F.shiftright(F.shiftright("key", 8) * 0x5851F42D, 20), F.lit(buckets)).cast("int").alias("bucket")
    asked = sent.select("bucket", "block", "keys").groupBy("bucket")
    told = asked.cogroup(scores(grams).select(place, "key", "logp").groupBy("bucket")).applyInArrow(C.lean(_answer, 2), "block int, bucket int, payload binary")
    out = block.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(C.lean(_score(buckets), 2), "doc_id long, lang string, n_bytes long, log_likelihood double")
    out = C.materialize(out)
    ppl = F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_likelihood") / F.col("n_bytes")))
    return out.join(good.withColumn("trusted", F.lit(True)), "doc_id", "left").select("doc_id", "lang", "n_bytes", ppl.alias("perplexity"), F.coalesce("trusted", F.lit(False)).alias("trusted"))


def _chosen(rows: DataFrame, uppers: tuple[float, ...], lowers: tuple[float, ...]) -> tuple[int, int]:
    """Places of the quantiles that decide most labelled rows rightly; of equals, those that keep most."""
    clean, bad = F.col("trusted") & _held(), F.col("bad") & ~F.col("trusted")
    at = [(i, j) for i in range(len(uppers)) for j in range(len(lowers))]
    kept = [F.col("perplexity").between(F.col("ls")[j], F.col("hs")[i]) for i, j in at]
    counts = [F.count_if(on & k) for k in kept for on in (clean, bad)]
    all_, held, no, *of = rows.filter("perplexity IS NOT NULL").agg(F.count_if("trusted"), F.count_if(clean), F.count_if(bad), *counts).first()  # a row of counts
    if not held or not no:
        return uppers.index(UPPER), lowers.index(LOWER)
    right = [all_ * c / held - b for c, b in zip(of[::2], of[1::2], strict=True)]
    return at[right.index(max(right))]


def classify(docs: DataFrame, trusted: DataFrame, bad: DataFrame | None = None, upper: float = UPPER, lower: float = LOWER) -> DataFrame:
    """A row per input row: doc_id, lang, n_bytes, perplexity, trusted, low, high, kept.

    trusted, bad: a column doc_id. With bad documents the quantiles are chosen, else they are upper and lower.
    """
    rows = C.materialize(perplexities(docs, trusted))
    known = rows.filter("trusted AND perplexity IS NOT NULL")
    uppers, lowers = (UPPERS, LOWERS) if bad is not None and not bad.isEmpty() else ((upper,), (lower,))
    cut = lambda df: df.agg(F.percentile_approx("perplexity", list(lowers), 10_000).alias("l"), F.percentile_approx(F.when(_held(), F.col("perplexity")), list(uppers), 10_000).alias("h"))
    by_lang = cut(known.groupBy("lang")).withColumnRenamed("lang", "of")
    low, high = cut(known).first()  # a few numbers
    rows = rows.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")
    none = F.lit(None).cast("array<double>")
    lit = lambda x: none if x is None else F.array(*map(F.lit, x))
    rows = rows.withColumn("ls", F.coalesce("l", lit(low))).withColumn("hs", F.coalesce("h", lit(high))).drop("l", "h")
    i = j = 0
    if len(uppers) > 1:
        said = bad.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("bad", F.lit(True))
        i, j = _chosen(rows.join(said, "doc_id", "left").withColumn("bad", F.coalesce("bad", F.lit(False))), uppers, lowers)
    rows = rows.withColumn("low", F.col("ls")[j]).withColumn("high", F.col("hs")[i]).drop("ls", "hs")
    return rows.withColumn("kept", F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.lit(True)))


def trusted_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id")


def bad_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 0 OR toxic = 1").select("doc_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = C.table(spark, sf_dir, "labels")
    out = classify(C.table(spark, sf_dir, "documents"), trusted_labels(labels), bad_labels(labels))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "high", "kept")


SQL: dict[str, str] = {}
