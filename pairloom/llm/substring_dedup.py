"""Removal of long repeated passages, by recompression.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window that holds it also
starts earlier (in a smaller doc_id, or earlier in the same document). Windows are judged on the input.

Recompression rewrites the word sequences in rounds. First every run of equal words becomes one symbol;
then, in each of ``ROUNDS`` rounds, every symbol is put left or right by its name, and each adjacent
(left, right) pair becomes one symbol. A round is one exchange over all documents: blocks send the pairs
(in the first round the runs too) that they hold, buckets gather equal ones and give each that occurs
twice a name of its own, a number that all blocks then use. What occurs once in the whole corpus gets
none and is *dead*: no repeated passage holds it, and nothing is paired with it again.

So equal passages consist of the same symbols but at their ends. A window's *parse* is what its words
alone determine: its first and last run, cut off as they may reach out of it; in each round the first
symbol if it is a right one, and the last if it is a left one, cut off as their partners may lie outside;
and the symbols of the highest level in between. Equal windows have equal parses, whatever surrounds
them. A window whose parse holds a dead symbol is not repeated and is dropped at that level; the others
are candidates, told apart by 64 bits of their parse and verified by 64 bits of their words, hashed
independently of the names.

Then blocks send each distinct candidate with its first place, buckets answer which places are not the
first of all, and blocks cut the words out. Copies inside a block are settled there, so that a window
that a third of all rows hold reaches its bucket once per block. Texts travel to their blocks once;
each round reads that exchange again. The number of blocks and of buckets follows from the bytes of
text, so a task holds some megabytes whatever the size of the table.

Null texts, empty texts and texts of blanks have no words. Rows with one doc_id count as the same
document: neither is earlier than the other. Rows without doc_id are one document before all others
(the id -2^63 is taken to be none). No other column is looked at. An empty table gives no rows.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

WINDOW, ROUNDS = 20, 3
#: Bits of a pair that buckets tell pairs apart by: two that agree share a name, which only costs a needless candidate.
_KEY_BITS = np.uint64(48)
#: Blocks to a bucket, and windows looked at in one go.
_BLOCKS_PER_BUCKET, _STEP = 8, 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_NO_ID = -(2**63)
_BEFORE = 1 << 20
_SENT = "bucket int, block int, kind int, payload binary"


class _Block:
    def __init__(self, rows: pa.Table, hashed: bool = True):
        self.rows = C.in_order(C.unblocked(rows))
        self.ids = C.column(self.rows, "doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.w = C.Words(C.column(self.rows, "text"), hashed=hashed)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Sums:
    """Polynomial hashes of any stretch of a sequence, independent of where it lies."""

    def __init__(self, x: np.ndarray):
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(x * _powers(len(x), _ODD)[: len(x)], dtype=np.uint64)))
        self.back = _powers(len(x), _BACK)

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.back[lo]


class _Parse:
    """The symbols of a block's words, level by level."""

    def __init__(self, w: C.Words):
        new = np.ones(len(w.h), bool)
        new[1:] = (w.h[1:] != w.h[:-1]) | (w.doc[1:] != w.doc[:-1])
        self.w, self.run_of = w, (np.cumsum(new) - 1).astype(np.int32)
        self.start = np.append(np.flatnonzero(new), len(w.h))
        length = np.diff(self.start)
        self.sym, self.doc = w.h[self.start[:-1]], w.doc[self.start[:-1]]
        self.runs = np.flatnonzero(length > 1)
        self.sym[self.runs] = C.join2(self.sym[self.runs], length[self.runs].astype(np.uint64), 7)
        self.levels: list[tuple] = []  # of each round before it: symbols, whether right, where each goes; and after it: dead symbols before each

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The round's distinct pairs (and runs), and whether the block has each more than once."""
        k, live = len(self.levels), self.sym != 0
        right = (C.mix(self.sym + np.uint64(0xA5A5 + k)) & np.uint64(1)).astype(bool)
        self.right = right
        self.pair = np.flatnonzero((live & ~right)[:-1] & (live & right)[1:] & (self.doc[:-1] == self.doc[1:]))
        keys = C.join2(self.sym[self.pair], self.sym[self.pair + 1], 100 + k)
        if not k:
            keys = np.concatenate((keys, C.mix(self.sym[self.runs])))
        keys, self.back, count = np.unique(keys >> (np.uint64(64) - _KEY_BITS), return_inverse=True, return_counts=True)
        return keys, count > 1

    def named(self, names: np.ndarray) -> None:
        """Takes the names of what asked() gave, 0 for what occurs once, and goes up a level."""
        k, n = len(self.levels), len(self.pair)
        got = names[self.back]
        got = np.where(got > 0, C.mix(got * _ODD + np.uint64(k + 1)), np.uint64(0))
        above = self.sym.copy()
        if not k:
            above[self.runs] = got[n:]
        above[self.pair] = got[:n]
        keep = np.ones(len(above), bool)
        keep[self.pair + 1] = False
        to = np.append(np.cumsum(keep) - 1, keep.sum()).astype(np.int32)
        before, self.sym, self.doc = self.sym, above[keep], self.doc[keep]
        dead = np.append(0, np.cumsum(self.sym == 0)).astype(np.int32)
        self.levels.append((before, self.right, to, dead))

    def candidates(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows without a dead symbol, and a fingerprint of the parse of each."""
        w, core = self.w, _Sums(self.sym)
        every = np.flatnonzero(w.pos + WINDOW <= w.count[w.doc])
        found = [self._parsed(every[lo : lo + _STEP], core) for lo in range(0, len(every), _STEP)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (every, every.astype(np.uint64))

    def _parsed(self, at: np.ndarray, core: _Sums) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.run_of[at], self.run_of[at + (WINDOW - 1)]
        one = a == b
        first, last = np.minimum(self.start[a + 1] - at, WINDOW), np.minimum(at + WINDOW - self.start[b], WINDOW)
        key = self.w.h[at] * _ODD + first.astype(np.uint64)
        key = (key * _ODD + self.w.h[at + (WINDOW - 1)]) * _ODD + last.astype(np.uint64)
        i, j = np.where(one, a, a + 1), b
        for sym, right, to, dead in self.levels:
            end = len(sym) - 1
            x = sym[np.minimum(i, end)]
            off = (i < j) & right[np.minimum(i, end)]
            fine = ~off | (x != 0)
            key = key * _ODD + np.where(off, x, np.uint64(0))
            i = i + off
            x = sym[np.maximum(j - 1, 0)]
            off = (i < j) & ~right[np.maximum(j - 1, 0)]
            fine &= ~off | (x != 0)
            key = key * _ODD + np.where(off, x, np.uint64(0))
            i, j = to[i], to[j - off]
            fine &= dead[i] == dead[j]
            at, key, i, j = at[fine], key[fine], i[fine], j[fine]
        return at, C.mix((key * _ODD + core.of(i, j)) * _ODD + (j - i).astype(np.uint64))

    def verified(self, at: np.ndarray) -> np.ndarray:
        """A fingerprint of the words of each window, by other word fingerprints than those of the names."""
        w, n = self.w, len(self.w.h)
        cover = np.zeros(n + 1, np.int32)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + WINDOW, -1)
        on = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        other = np.zeros(n, np.uint64)
        other[on] = C.span_hashes(w.buf, w.starts[on], w.ends[on], seed=1)
        return C.mix(_Sums(other).of(at, at + WINDOW))


def _sent(block: int, found: list[tuple[int, int, bytes]]) -> pa.Table:
    bucket, kind, payload = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array([block] * len(bucket), pa.int32()), "kind": pa.array(kind, pa.int32()), "payload": pa.array(payload, pa.binary())})


def _asked(block: int, parse: _Parse, buckets: int) -> list[tuple[int, int, bytes]]:
    keys, many = parse.asked()
    return [(b, 0, C.pack_ascending(keys[p], np.packbits(many[p]))) for b, p in C.spread(keys, buckets)]


def _opened(replies: pa.Table) -> list[tuple[int, bytes]]:
    """(round, reply): those of the last round, and those of earlier ones, which travel on as one row."""
    out = []
    for kind, payload in zip(replies.column("kind").to_pylist(), replies.column("payload").to_pylist(), strict=True):
        out += pickle.loads(payload) if kind == _BEFORE else [(kind, payload)]
    return out


def _told(block: _Block, replies: pa.Table, buckets: int, rounds: int) -> _Parse:
    """The block's symbols after so many rounds; without a reply nothing of the block is shared."""
    parse, by = _Parse(block.w), {}
    for kind, payload in _opened(replies):
        by.setdefault(kind, []).append(payload)
    for k in range(1, rounds + 1):
        keys, _ = parse.asked()
        names, dealt = np.zeros(len(keys), np.uint64), dict(C.spread(keys, buckets))
        for payload in by.get(k, ()):
            ranks, (shared, bucket) = C.unpack_ascending(payload)
            place = dealt[int(bucket[0])]
            names[place[np.unpackbits(shared, count=len(place)).astype(bool)]] = ranks * np.uint64(buckets) + np.uint64(bucket[0] + 1)
        parse.named(names)
    return parse


def _first_round(buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        number = rows.column("block")[0].as_py()
        return _sent(number, _asked(number, _Parse(_Block(rows).w), buckets))

    return run


def _next_round(buckets: int, done: int):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _sent(0, [])
        number = rows.column("block")[0].as_py()
        before = (number % buckets, _BEFORE, pickle.dumps(_opened(replies)))
        return _sent(number, [before, *_asked(number, _told(_Block(rows), replies, buckets, done), buckets)])

    return run


def _names(round_: int):
    """A bucket names what several places have, in order of its keys; replies of earlier rounds pass through."""

    def run(rows: pa.Table) -> pa.Table:
        through = pc.greater(rows.column("kind"), 0)
        out = rows.filter(through)
        rows = rows.filter(pc.invert(through))
        if rows.num_rows:
            got = [C.unpack_ascending(x) for x in rows.column("payload").to_pylist()]
            n = [len(keys) for keys, _ in got]
            many = np.concatenate([np.unpackbits(m, count=len(keys)).astype(bool) for keys, (m,) in got])
            _, back, count = np.unique(np.concatenate([keys for keys, _ in got]), return_inverse=True, return_counts=True)
            shared = (count > 1) | (np.bincount(back, many) > 0)
            rank = (np.cumsum(shared) - 1).astype(np.uint64)
            bucket = np.array([rows.column("bucket")[0].as_py()], np.int64)
            replies = []
            for own in np.split(back, np.cumsum(n)[:-1]):
                on = shared[own]
                replies.append(C.pack_ascending(rank[own[on]], np.packbits(on), bucket) if on.any() else None)
            told = rows.set_column(rows.schema.get_field_index("payload"), "payload", pa.array(replies, pa.binary()))
            told = told.set_column(told.schema.get_field_index("kind"), "kind", pa.array([round_] * told.num_rows, pa.int32()))
            out = pa.concat_tables([out, told.filter(pc.is_valid(told.column("payload")))])
        return out

    return run


def _send_windows(buckets: int):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _sent(0, [])
        number, block = rows.column("block")[0].as_py(), _Block(rows)
        parse = _told(block, replies, buckets, ROUNDS)
        at, key = parse.candidates()
        words = parse.verified(at)
        ids, pos = block.ids[block.w.doc[at]], block.w.pos[at]
        order = np.lexsort((pos, ids, words, key))
        new = np.ones(len(at), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (words[order][1:] != words[order][:-1])
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(at) else order  # the earliest with the same words
        later = order[(ids[order] != ids[lead]) | (pos[order] != pos[lead])]
        equal = order[~new & (ids[order] == ids[lead]) & (pos[order] == pos[lead])]  # rows that repeat a doc_id
        out = [(number % buckets, 1, C.pack(np.sort(at[later]).astype(np.int32)))] if len(later) else []
        first = np.sort(np.concatenate((order[new], equal)))
        out += [(b, 0, C.pack(key[f], words[f], ids[f], pos[f], at[f].astype(np.int32))) for b, f in ((b, first[p]) for b, p in C.spread(key[first], buckets))]
        return _sent(number, out)

    return run


def _not_first(rows: pa.Table) -> pa.Table:
    """Places that are not the first with their words; what a block has settled itself passes through."""
    block, kind, blobs = (rows.column(x).to_pylist() for x in ("block", "kind", "payload"))
    out = [(k, b, x) for k, b, x in zip(kind, block, blobs, strict=True) if k == 1]
    asked = [(b, C.unpack(x)) for k, b, x in zip(kind, block, blobs, strict=True) if k == 0]
    if asked:
        key, words, ids, pos, at = (np.concatenate([x[i] for _, x in asked]) for i in range(5))
        whose = np.repeat([b for b, _ in asked], [len(x[0]) for _, x in asked])
        order = np.lexsort((pos, ids, words, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (words[order][1:] != words[order][:-1])
        lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = order[(ids[order] != ids[lead]) | (pos[order] != pos[lead])]
        late = late[np.argsort(whose[late], kind="stable")]
        out += [(1, int(whose[p[0]]), C.pack(np.sort(at[p]))) for p in np.split(late, np.flatnonzero(np.diff(whose[late])) + 1) if len(p)]
    return pa.table({"block": pa.array([b for _, b, _ in out], pa.int32()), "payload": pa.array([x for *_, x in out], pa.binary())})


def _cut(spacing: bool, carried: bool):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(rows, hashed=False)
        w, n = block.w, len(block.w.starts)
        more = np.zeros(n + 1, np.int32)
        for x in replies.column("payload").to_pylist():
            at = C.unpack(x)[0]
            np.add.at(more, at, 1)
            np.add.at(more, at + WINDOW, -1)
        gone = np.cumsum(more[:-1]) > 0
        lost = np.concatenate(([0], np.cumsum(gone)))
        removed = lost[w.first[1:]] - lost[w.first[:-1]]
        raw, texts, whole = w.buf.tobytes(), [], C.column(block.rows, "text").to_pylist() if spacing else None
        for i in range(len(block.ids)):
            lo, hi = w.first[i], w.first[i + 1]
            if spacing:
                if not removed[i]:
                    texts.append(whole[i])
                    continue
                keep = np.flatnonzero(np.diff(np.concatenate(([True], gone[lo:hi], [True])).view(np.int8)))
                texts.append(" ".join(raw[w.starts[lo + a] : w.ends[lo + b - 1]].decode() for a, b in zip(keep[0::2], keep[1::2], strict=True)))
            else:
                words = raw[w.starts[lo] : w.ends[hi - 1]].split() if hi > lo else []
                if removed[i]:
                    words = [words[k] for k in np.flatnonzero(~gone[lo:hi])]
                texts.append(b" ".join(words).decode())
        out = {"doc_id": block.rows.column("doc_id"), "n_words": pa.array(w.count, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.string())}
        return pa.table(out | ({"carried": block.rows.column("carried")} if carried else {}))

    return run


def dedup_substrings(docs: DataFrame, spacing: bool = False, carry: bool = False) -> DataFrame:
    """A row per input row: doc_id, n_words, n_removed, kept_text.

    kept_text joins the kept words by one space; with ``spacing`` it keeps the blanks of the text
    between words that stay together, and a text that loses nothing, null included, as it is.
    ``carry`` adds the input row but for its text as the struct ``carried``.
    """
    blocks = C.blocks_of(docs)
    buckets = max(C.partitions(docs.sparkSession), blocks // _BLOCKS_PER_BUCKET)
    rest = F.struct(*(docs[f"`{c}`"] for c in docs.columns if c != "text")).alias("carried")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([rest] if carry else []))
    block = C.blocked_tight(slim, slim.columns, blocks)
    only = C.blocked_tight(slim, ["doc_id", "text"], blocks) if carry else block
    answered = lambda df, f, schema: C.dealt(df, buckets, "bucket").groupBy("bucket").applyInArrow(C.lean(f, 1), schema)
    told = answered(only.groupBy("block").applyInArrow(C.lean(_first_round(buckets), 1), _SENT), _names(1), _SENT)
    for k in range(2, ROUNDS + 1):
        told = answered(only.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(C.lean(_next_round(buckets, k - 1), 2), _SENT), _names(k), _SENT)
    asked = only.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(C.lean(_send_windows(buckets), 2), _SENT)
    late = answered(asked, _not_first, "block int, payload binary")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    if carry:
        schema.add("carried", slim.schema["carried"].dataType)
    return block.groupBy("block").cogroup(late.groupBy("block")).applyInArrow(C.lean(_cut(spacing, carry), 2), schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = {
    "op1_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, unnest(range(0, len(ws) - 19)) AS s, ws FROM w WHERE len(ws) >= 20
), keyed AS (
  SELECT doc_id, s, array_to_string(list_slice(ws, s + 1, s + 20), ' ') AS k FROM win
), late AS (
  SELECT doc_id, s FROM keyed QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1
), gone AS (
  SELECT doc_id, list_sort(list_distinct(flatten(list(range(s, s + 20))))) AS g FROM late GROUP BY doc_id
), kept AS (
  SELECT w.doc_id, len(ws) AS n_words, coalesce(len(g), 0) AS n_removed,
         CASE WHEN g IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(g, i - 1)) END AS k
  FROM w LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
""",
}
