"""What several operators of this subpackage share: tables, scratch space, word fingerprints and blocks.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of a text, taken byte by byte from its UTF-8 form with
numpy; a word's fingerprint depends on its bytes alone, so every task gives a word the same name.
"""

from __future__ import annotations

import atexit
import ctypes
import hashlib
import itertools
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a word up to which its fingerprint is computed eight bytes at a time.
_VECTOR_BYTES = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN_SCRATCH: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the cluster names. Where none is named, a local one that goes with the process, and an error on a cluster, whose executors would not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN_SCRATCH:
            own = tempfile.mkdtemp(prefix="pairloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            _OWN_SCRATCH.append(f"file://{own}")
        base = _OWN_SCRATCH[0]
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: the lineage is cut, and lost executors lose nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- fingerprints


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits whose output bits each depend on all input bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(32))
        x = x * U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        x ^= x >> U64(32)
    return x


def join2(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """The name of the pair (a, b) under a salt."""
    with np.errstate(over="ignore"):
        return mix(a * U64(0x9E3779B97F4A7C15) + ((b << U64(29)) | (b >> U64(35))) + U64(salt))


#: Masks that keep the first 0 to 8 bytes of eight.
_FIRST = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit fingerprints of byte ranges, independent from seed to seed."""
    n = ends - starts
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    with np.errstate(over="ignore"):
        out = mix((eight[starts] & _FIRST[np.minimum(n, 8)]) ^ (n.astype(U64) * U64(0xC2B2AE3D27D4EB4F) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64))))
    live, at = np.flatnonzero((n > 8) & (n <= _VECTOR_BYTES)), 8
    while len(live):
        out[live] = mix(out[live] ^ (eight[starts[live] + at] & _FIRST[np.minimum(n[live] - at, 8)]))
        at += 8
        live = live[n[live] > at]
    for i in np.flatnonzero(n > _VECTOR_BYTES):
        raw = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=str(seed).encode())
        out[i] = int.from_bytes(raw.digest(), "little")
    return out


class Words:
    """The words of some texts, one after the other: fingerprints ``h``, the row ``doc`` of each, its place ``pos`` in the row.

    ``buf`` holds the texts' bytes without a gap; a text's end also ends its last word. ``first`` is the
    first word of each text (and the number of all), ``count`` a text's number of words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, hashed: bool = True):
        raw = pc.fill_null(texts.cast(pa.large_string()), "")
        size = len(raw)
        at = np.frombuffer(raw.buffers()[1], np.int64, size + 1, 8 * raw.offset) if size else np.zeros(1, np.int64)
        data = raw.buffers()[2] if size else None
        self.buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
        at = at - at[0]
        if lower:
            self.buf = np.where((self.buf >= 65) & (self.buf <= 90), self.buf + np.uint8(32), self.buf)
        blank = np.flatnonzero(_SPACE[self.buf])
        starts, ends = np.concatenate((blank + 1, at[:-1])), np.concatenate((blank, at[1:]))
        starts.sort(kind="stable")
        ends.sort(kind="stable")
        some = ends > starts
        self.starts, self.ends = starts[some], ends[some]
        self.first = np.searchsorted(self.starts, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(size, dtype=np.int32), self.count)
        self.pos = (np.arange(len(self.starts)) - np.repeat(self.first[:-1], self.count)).astype(np.int32)
        if hashed:
            self.h = span_hashes(self.buf, self.starts, self.ends)

    def grams(self, width: int, salt: int = 0) -> np.ndarray:
        """Names of the ``width`` words from each word on; the last ``width`` - 1 of a row reach into the next, or are cut off at the end."""
        powers, size = {1: self.h}, 1
        while size * 2 <= width:
            p = powers[size]
            powers[size * 2] = join2(p[: max(0, len(p) - size)], p[size:], salt + size)
            size *= 2
        out, done = powers[size], size
        while done < width:
            size = 1 << ((width - done).bit_length() - 1)
            more = powers[size][done:]
            n = max(0, min(len(out), len(more)))
            out = join2(out[:n], more[:n], salt + 1000 + done)
            done += size
        return out


# --- blobs: arrays as bytes, so that the JVM moves a few large rows


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (np.dtype(a.dtype).num, len(a)))], np.int64)
    return zstandard.ZstdCompressor(level=1).compress(head.tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


_KINDS = {np.dtype(x).num: np.dtype(x) for x in ("u1", "u2", "u4", "u8", "i4", "i8", "f4", "f8")}


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 1 + 2 * n)[1:], 8 * (1 + 2 * n), []
    for kind, size in head.reshape(-1, 2):
        out.append(np.frombuffer(raw, _KINDS[int(kind)], int(size), at))
        at += int(size) * _KINDS[int(kind)].itemsize
    return out


def planes(x: np.ndarray) -> np.ndarray:
    """The bytes of whole numbers, first all lowest ones, then the next: small numbers leave planes of zeros, which compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel()


def numbers(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def pack_ascending(x: np.ndarray, *more: np.ndarray) -> bytes:
    """Ascending numbers as differences, and other arrays."""
    return pack(planes(np.diff(x, prepend=U64(0))), *more)


def unpack_ascending(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    steps, *more = unpack(blob)
    return np.cumsum(numbers(steps), dtype=U64), more


# --- blocks: texts by a hash of their key, so that what is said about a block reaches the same rows again

#: Bytes of text in a block, about: what a task holds at once, whatever the size of the table.
BLOCK_BYTES = 4 << 20


def blocks_of(docs: DataFrame) -> int:
    """How many blocks the column text needs; one for each shuffle partition at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(docs.sparkSession), -(-size // BLOCK_BYTES))


def dealt(df: DataFrame, blocks: int, by: str = "block") -> DataFrame:
    """Rows by block (or bucket), a task for every two of them, once all cores have one."""
    return df.repartition(max(partitions(df.sparkSession), -(-blocks // 2)), by)


def blocked(docs: DataFrame, columns: list[str], blocks: int) -> DataFrame:
    """The columns and ``block``, dealt by it. The block follows from doc_id alone, so a task that runs again finds the same rows."""
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    return dealt(docs.select(block, *columns), blocks)


#: Bytes that a task holds before it sends its parts of blocks.
_HELD_BYTES = 24 << 20


def _block_parts(batches):
    held: dict[int, list] = {}
    size = 0

    def sent():
        for block, parts in held.items():
            rows, sink = pa.concat_tables(parts).combine_chunks(), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows)
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
        held.clear()

    for batch in batches:
        rows = pa.Table.from_batches([batch]).sort_by("block")
        block = rows.column("block").to_numpy()
        rows = rows.drop_columns(["block"])
        for lo, hi in itertools.pairwise((0, *(np.flatnonzero(np.diff(block)) + 1), len(block))):
            if hi > lo:
                held.setdefault(int(block[lo]), []).append(rows.slice(lo, hi - lo))
        size += batch.nbytes
        if size > _HELD_BYTES:
            yield from sent()
            size = 0
    yield from sent()


def blocked_tight(docs: DataFrame, columns: list[str], blocks: int) -> DataFrame:
    """As blocked, but rows travel as compressed parts of blocks: (block, payload). unblocked() opens them."""
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    return dealt(docs.select(block, *columns).mapInArrow(_block_parts, "block int, payload binary"), blocks)


def lean(work: Callable, sides: int) -> Callable:
    """work of one table or two, after which what it freed goes back to the system: an idle worker's memory counts as its executor's."""

    def freed(out: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)
        return out

    def one(rows: pa.Table) -> pa.Table:
        return freed(work(rows))

    def two(rows: pa.Table, other: pa.Table) -> pa.Table:
        return freed(work(rows, other))

    return one if sides == 1 else two


def unblocked(rows: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x).read_all() for x in rows.column("payload").to_pylist()])


def in_order(rows: pa.Table) -> pa.Table:
    """The rows by doc_id and text, whatever order they came in."""
    ids = column(rows, "doc_id")
    keys = ["doc_id"] if len(pc.unique(ids)) == len(ids) else ["doc_id", "text"]
    return rows.sort_by([(k, "ascending") for k in keys]).combine_chunks()


def column(rows: pa.Table, name: str) -> pa.Array:
    out = rows.column(name).combine_chunks()
    return out if isinstance(out, pa.Array) else pa.concat_arrays(out.chunks)


def spread(keys: np.ndarray, buckets: int):
    """(bucket, places of its keys in their order) for each bucket that has any."""
    b = (keys % U64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.diff(b[order])) + 1
    for part in np.split(order, cut) if len(order) else ():
        yield int(b[part[0]]), part
