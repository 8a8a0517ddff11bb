"""Language of a text: the family first, then one-versus-one linear support vector machines within it.

A text's features are the square roots of the shares of its hashed byte n-grams (1 to 3 bytes, letters
of A-Z lower-cased), ``SIZE`` of them, and a constant. Families come from ``FAMILIES`` (languages that
are not named there form families of their own). A one-versus-one vote of machines tells families
apart, and another such vote the languages within the family that won; each machine is trained with
squared hinge loss by Newton steps on a bounded sample, at most ``PER_LANGUAGE`` whole texts of each
language (those of smallest hash of their id; the bound is a parameter of training only). Features are
made where the texts lie, so the driver gets ``SIZE`` numbers a sampled text, however long it is.

Null texts and texts without a letter are ``und`` with score 0; so is every text if nothing was
labelled. The score is the logistic function of the smallest margin that the language won by, times the
family's. Ties go to the name that sorts first. Rows are predicted each by their own text; other columns
are not looked at. A row without doc_id is not learned from, and counts as held out.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .near_dedup import slices

SIZE, PER_LANGUAGE = 2048, 400
#: Languages by family: fixed values.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv"),
    "romance": ("ca", "es", "fr", "gl", "it", "pt", "ro"),
    "slavic": ("bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"),
}
_LETTER = re.compile(r"[^\W\d_]")


def family(lang: str) -> str:
    return next((f for f, names in FAMILIES.items() if lang in names), lang)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of SIZE + 1 numbers for each text."""
    buf = np.frombuffer(b" ".join(texts) + b"   ", np.uint8).astype(np.uint32)
    buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    row = np.repeat(np.arange(len(texts)), size + 1)
    n = len(row)
    ends = np.cumsum(size + 1) - 1  # of each text; n-grams stop there
    left = np.repeat(ends, size + 1) - np.arange(n)
    out = np.zeros(len(texts) * SIZE, np.float64)
    a, b, c = buf[:n], buf[1 : n + 1], buf[2 : n + 2]
    for k, key in ((1, a), (2, a * np.uint32(257) + b), (3, (a * np.uint32(257) + b) * np.uint32(263) + c)):
        own = left >= k
        h = (((key[own] + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(SIZE)
        out += np.bincount(row[own] * SIZE + h, minlength=len(out))
    out = out.reshape(len(texts), SIZE)
    out = np.sqrt(out / np.maximum(out.sum(axis=1, keepdims=True), 1))
    return np.hstack([out, np.ones((len(texts), 1))])


def _machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Weights of a linear support vector machine, squared hinge loss, classes weighted evenly; y is 1 or -1."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * len(y) * cost
    w = np.zeros(x.shape[1])
    for _ in range(30):
        slack = 1 - y * (x @ w)
        on = slack > 0
        grad = w - x[on].T @ (weight[on] * y[on] * slack[on])
        hess = np.eye(len(w)) + x[on].T @ (x[on] * weight[on, None])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _pairs(x: np.ndarray, names: np.ndarray) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
    """Labels, pairs of them, and a machine for each pair (positive: the first)."""
    labels = sorted(set(names))
    pairs = list(itertools.combinations(range(len(labels)), 2))
    rows = []
    for i, j in pairs:
        on = (names == labels[i]) | (names == labels[j])
        rows.append(_machine(x[on], np.where(names[on] == labels[i], 1.0, -1.0)))
    return labels, pairs, np.array(rows).reshape(len(pairs), x.shape[1])


def train(x: np.ndarray, langs: list[str]) -> dict:
    """The families' machines, and those of each family, from rows of features."""
    names, kin = np.array(langs, object), np.array([family(v) for v in langs], object)
    return {"families": _pairs(x, kin), "within": {f: _pairs(x[kin == f], names[kin == f]) for f in set(kin)}} if len(langs) else {}


def _vote(x: np.ndarray, machines) -> tuple[np.ndarray, np.ndarray]:
    """The winning label's number for each row, and its smallest margin."""
    labels, pairs, w = machines
    if not pairs:
        return np.zeros(len(x), np.int64), np.full(len(x), 10.0)
    margin = x @ w.T
    votes, least = np.zeros((len(x), len(labels))), np.full((len(x), len(labels)), np.inf)
    for k, (i, j) in enumerate(pairs):
        votes[:, i] += margin[:, k] > 0
        votes[:, j] += margin[:, k] <= 0
        least[:, i], least[:, j] = np.minimum(least[:, i], margin[:, k]), np.minimum(least[:, j], -margin[:, k])
    best = np.argmax(np.where(votes == votes.max(axis=1, keepdims=True), np.maximum(least, -1e9), -np.inf), axis=1)
    return best, least[np.arange(len(x)), best]


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], list[float]]:
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if model else []
    if rows:
        x = features([texts[i].encode() for i in rows])
        sure = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        kin, first = _vote(x, model["families"])
        for k, f in enumerate(model["families"][0]):
            own = np.flatnonzero(kin == k)
            if len(own):
                machines = model["within"][f]
                best, margin = _vote(x[own], machines)
                for at, b, s in zip(own, best, sure(margin) * sure(first[own]), strict=True):
                    lang[rows[at]], score[rows[at]] = machines[0][b], float(s)
    return lang, score


def _sampled(batches):
    for batch in batches:
        for part in slices(batch):
            x = features([t.encode() for t in part.column("text").to_pylist()]).astype(np.float32)
            yield pa.RecordBatch.from_pydict({"lang": part.column("lang"), "h": part.column("h"), "x": pa.array([row.tobytes() for row in x], pa.binary())})


def identify(docs: DataFrame, labelled: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """A row per input row: doc_id, lang_pred, score. labelled: text and lang (not null), of which a bounded sample is learned from."""
    known = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "text").alias("h"))
    share = {r.lang: min(1.0, 1.3 * per_language / r["count"]) for r in known.groupBy("lang").count().collect()}  # a row per language
    got: list = []
    if share:
        part = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")]
        drawn = known.filter(F.pmod("h", F.lit(1_000_000)) < part * 1_000_000)  # about 1.3 times as many as are used
        drawn = drawn.select("lang", "h", "text").mapInArrow(_sampled, "lang string, h long, x binary")
        nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "x"))
        got = drawn.withColumn("nth", nth).filter(F.col("nth") <= per_language).select("lang", "h", "x").collect()
        got = sorted((r.lang, r.h, bytes(r.x)) for r in got)
    x = np.frombuffer(b"".join(r[2] for r in got), np.float32).reshape(len(got), SIZE + 1).astype(np.float64)
    model = docs.sparkSession.sparkContext.broadcast(train(x, [r[0] for r in got]))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                lang, score = predict(model.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())})

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = identify(docs, docs.filter(~held))
    return out.select("doc_id", F.coalesce(held, F.lit(True)).alias("held_out"), "lang_pred", "score")
