"""Packing of documents into sequences of at most ``CAPACITY`` tokens, by minimum bin slack.

A document's ids (byte-level BPE, then id 0 as its end) are cut into full pieces of CAPACITY ids and a
rest. Full pieces are sequences by themselves. Of the rests only the numbers of each length are
gathered, CAPACITY - 1 counts whatever the corpus; from them the driver builds *patterns*, multisets of
lengths: the largest length left is put in, a bitset subset-sum over the counted lengths finds the
fullest sum that fits beside it, and walking back through the bitsets gives how many of each length
reach it. A pattern is used as often as its counts last. Each rest then takes the slot of its number
among the rests of its length, which follows from counts by task, so nothing else is gathered.

A sequence below CAPACITY is padded; none of a power of two is. Null texts count as empty: one id, 0.
Repeated rows are packed each for itself. Pieces carry a row number of their own beside doc_id, so
rows with one doc_id stay apart. No other column is looked at. The string of a special token in a
text is that token in the registered query and the pipeline; ``pack`` by itself reads it as ordinary
text unless told ``specials=True``. An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .near_dedup import slices

CAPACITY = 1024
#: Places of the tokenizer's files; the same vocabulary as byte_bpe_50k.json, which tests confirm.
RANKS = "byte_bpe_50k.tiktoken"
#: Added special tokens of byte_bpe_50k.json: cut out of a text before anything else.
SPECIALS = {"<|endoftext|>": 50256}
_SPECIAL = re.compile("(" + "|".join(map(re.escape, SPECIALS)) + ")")
#: The pattern's search backtracks over a run of blanks and fails at about a million: runs of so many are cut out before.
LONG = 10_000
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # \s of the pattern, without \x1c to \x1f of Python's
_RUN = re.compile(f"(?<![{_BLANK}])[{_BLANK}]{{{LONG},}}")
_ENCODINGS: dict = {}
_PIECES = "doc_id long, start long, length long, doc_tokens long, part long, nth long, ids binary, ids_crc32 long"


def encoding(path: str | None = None):
    """The tokenizer of text without special tokens, once per process."""
    if path not in _ENCODINGS:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def encoder(path: str | None = None, specials: bool = False) -> Callable[[str], list[int]]:
    """From a text to its ids, as tokenizers gives them. specials: whether special tokens' strings are those tokens or ordinary text."""
    enc = encoding(path)

    def ordinary(text: str) -> list[int]:
        if len(text) < LONG:
            return enc.encode_ordinary(text)
        out, at = [], 0
        for run in _RUN.finditer(text):
            # one piece of the pattern: all of the run at the end of the text, else all but its last blank
            end = run.end() - (run.end() < len(text))
            out += enc.encode_ordinary(text[at : run.start()])
            out += enc._encode_single_piece(text[run.start() : end])
            at = end
        return out + enc.encode_ordinary(text[at:])

    def encode(text: str) -> list[int]:
        parts = _SPECIAL.split(text)  # text and special token in turn; each text by itself, as in tokenizers
        return [x for k, part in enumerate(parts) for x in ((SPECIALS[part],) if k % 2 else ordinary(part))] if len(parts) > 1 else ordinary(text)

    return encode if specials else ordinary


def _pieces(capacity: int, path: str | None, specials: bool):
    def run(batches):
        encode, part = encoder(path, specials), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)  # pieces of each length so far in this task
        for batch in batches:
            for rows in slices(batch):
                cols: list[list] = [[] for _ in range(8)]
                for doc, text in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), 0], "<u4")
                    raw = ids.tobytes()
                    for start in range(0, len(ids), capacity):
                        n = min(capacity, len(ids) - start)
                        blob = raw[4 * start : 4 * (start + n)]
                        for c, x in zip(cols, (doc, start, n, len(ids), part, int(seen[n]), blob, zlib.crc32(blob)), strict=True):
                            c.append(x)
                        seen[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(cols)], names=["doc_id", "start", "length", "doc_tokens", "part", "nth", "ids", "ids_crc32"])

    return run


def _fullest(counts: np.ndarray, room: int) -> dict[int, int]:
    """The multiset of counted lengths with the largest sum up to room."""
    mask, sets = (1 << (room + 1)) - 1, [(0, 0, 1)]
    best = 0
    for n in range(min(room, len(counts) - 1), 0, -1):
        left, step = min(int(counts[n]), room // n), 1
        while left:  # in parts of 1, 2, 4, ... lengths, so that a few shifts cover any number
            k = min(step, left)
            reach = (sets[-1][2] | (sets[-1][2] << (n * k))) & mask
            sets.append((n, k, reach))
            left, step = left - k, step * 2
        best = sets[-1][2].bit_length() - 1
        if best == room:
            break
    out: dict[int, int] = {}
    for (n, k, _), (*_, before) in zip(reversed(sets[1:]), reversed(sets[:-1]), strict=True):
        if not (before >> best) & 1:
            out[n] = out.get(n, 0) + k
            best -= n * k
    return out


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths with their numbers, times used) until no length is left. counts[n]: rests of length n."""
    counts, out = counts.copy(), []
    while len(full := np.flatnonzero(counts)):
        top = int(full[-1])
        counts[top] -= 1
        used = _fullest(counts, capacity - top)
        counts[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(int(counts[n]) // k for n, k in used.items())
        for n, k in used.items():
            counts[n] -= k * times
        out.append((used, times))
    return out


def _slots(plan: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, tuple]:
    """By length, columns over its slot ranges: first number, slots in a sequence, first sequence, first offset."""
    by: dict[int, list] = {}
    taken, sequence = np.zeros(capacity + 1, np.int64), 0
    for used, times in plan:
        at = 0
        for n in sorted(used, reverse=True):
            by.setdefault(n, []).append((int(taken[n]), used[n], sequence, at))
            taken[n] += used[n] * times
            at += n * used[n]
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) for n, x in by.items()}


def _by_length(capacity: int):
    """One row per task: the number of its first piece of each length."""

    def run(rows: pa.Table) -> pa.Table:
        base = np.zeros(capacity + 1, np.int64)
        base[rows.column("length").to_numpy()] = rows.column("base").to_numpy()
        return pa.table({"part": rows.column("part").slice(0, 1), "base": pa.array([base], pa.list_(pa.int64()))})

    return run


def _placed(slots: dict[int, tuple]):
    def run(batches):
        for batch in batches:
            length, number = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                first, each, seq, at = slots[int(n)]
                k = np.searchsorted(first, number[rows], side="right") - 1
                copy, nth = np.divmod(number[rows] - first[k], each[k])
                sequence[rows], offset[rows] = seq[k] + copy, at[k] + nth * n
            out = {c: batch.column(c) for c in batch.schema.names if c != "number"}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, ids: bool = True, specials: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = slim.mapInArrow(_pieces(capacity, path, specials), _PIECES)
    pieces = C.materialize(pieces if ids else pieces.drop("ids"))
    counted = C.materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length, capacity at most
        counts[r.length] = r.n
    slots = _slots(patterns(counts, capacity), capacity)
    # number of the first piece of each length in each task: by spans of tasks, then within them
    span = F.floor(F.col("part") / 64)
    spans = counted.groupBy("length", span.alias("span")).agg(F.sum("n").alias("all"))
    over = F.expr("sum(all) OVER (PARTITION BY length ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    spans = spans.select("length", "span", F.coalesce(over, F.lit(0)).alias("before"))
    own = F.expr("sum(n) OVER (PARTITION BY length, span ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    base = counted.withColumn("span", span).select("length", "span", "part", F.coalesce(own, F.lit(0)).alias("inside")).join(spans, ["length", "span"])
    base = base.select("part", "length", (F.col("before") + F.col("inside")).alias("base")).groupBy("part").applyInArrow(_by_length(capacity), "part long, base array<long>")
    names = ["doc_id", "start", "length", "doc_tokens", "ids_crc32", *(["ids"] if ids else [])]
    first = F.element_at("base", (F.col("length") + 1).cast("int"))
    numbered = pieces.join(C.materialize(base), "part").select(*names, (first + F.col("nth")).alias("number"))
    kinds = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in names)
    return numbered.mapInArrow(_placed(slots), f"{kinds}, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(C.table(spark, sf_dir, "documents"), ids=False, specials=True)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


SQL: dict[str, str] = {}
