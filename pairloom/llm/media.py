"""Media columns: each text as a progressive JPEG, read back into coefficients and full-resolution RGB.

The payload is the text's UTF-8 bytes, filled with zero bytes to a positive multiple of 64. The unit of
the format is the coefficient: a block's 64 bytes are its 64 quantised coefficients (quantisation 1), four
blocks of luma and one each of chroma to an MCU, so nothing is lost. Scans go by spectral bands and in two
bits' steps of successive approximation. Reading back decodes the stored bytes scan by scan.

The RGB tensor comes from the inverse transform (whole numbers, exact), chroma upsampled by repetition.
The feature is 'width x height: sums of red, green, blue'. Null texts are empty: 64 zero bytes. Each row
is stored for itself, equal texts in equal bytes. A value of Spark, 2 GB at most, makes an image of 2,400
MCUs across; the format allows 4,095. Other columns than doc_id and text are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import jpeg
from .near_dedup import slices

def _stored(batches):
    for batch in batches:
        for part in slices(batch):
            media, sizes = [], []
            for text in part.column("text").cast(pa.binary()).to_pylist():
                raw = text or b""
                payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
                media.append(jpeg.encode(payload, struct.pack(">Q", len(raw))))
                sizes.append(len(raw))
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "media": pa.array(media, pa.binary())})


def stored(docs: DataFrame) -> DataFrame:
    """A row per input row: doc_id, n_bytes, media (the file)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _rgb(blocks: np.ndarray) -> np.ndarray:
    """Pixels of MCUs: (n, 16, 16, 3)."""
    s = jpeg.samples(blocks.reshape(-1, 64)).reshape(-1, 6, 8, 8)
    y = s[:, :4].reshape(-1, 2, 2, 8, 8).transpose(0, 1, 3, 2, 4).reshape(-1, 16, 16)
    up = lambda c: c.repeat(2, axis=1).repeat(2, axis=2)
    return jpeg.to_rgb(y, up(s[:, 4]), up(s[:, 5]))


def _read(tensors: bool):
    def run(batches):
        for batch in batches:
            rows, at = list(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True)), 0
            while at < len(rows):
                many, size = [], 0
                while at < len(rows) and (not many or size < 1 << 20):
                    many.append(rows[at])
                    size += len(rows[at][2])
                    at += 1
                yield _read_some(many, tensors)

    return run


def _read_some(rows: list, tensors: bool) -> pa.RecordBatch:
    images = [jpeg.decode(m) for *_, m in rows]
    blocks = [jpeg.blocks_of(i) for i in images]
    n = [len(b) for b in blocks]
    step, sums, tiles = 4096, [], []
    every = np.concatenate(blocks)
    for lo in range(0, len(every), step):
        rgb = _rgb(every[lo : lo + step])
        sums.append(rgb.sum(axis=(1, 2), dtype=np.int64))
        if tensors:
            tiles.append(rgb)
    sums = np.add.reduceat(np.concatenate(sums), np.concatenate(([0], np.cumsum(n)[:-1])))
    out: dict = {c: [] for c in ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *(("height", "width", "rgb") if tensors else ()))}
    pixels = np.split(np.concatenate(tiles), np.cumsum(n)[:-1]) if tensors else None
    for k, ((doc, _, media), image) in enumerate(zip(rows, images, strict=True)):
        size = struct.unpack(">Q", image["comment"])[0]
        whole = -(-size // 64) * 64 or 64
        payload = jpeg.payload_of(blocks[k])[: whole // 64].tobytes()
        found = [doc, size, whole, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{image['width']}x{image['height']}:" + ",".join(map(str, sums[k].tolist()))]
        if tensors:
            across, down = image["mcus"]
            found += [image["height"], image["width"], pixels[k].reshape(down, across, 16, 16, 3).transpose(0, 2, 1, 3, 4).tobytes()]
        for c, x in zip(out.values(), found, strict=True):
            c.append(x)
    kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string(), "rgb": pa.binary()}
    return pa.RecordBatch.from_pydict({c: pa.array(x, kinds.get(c, pa.int64())) for c, x in out.items()})


def read_back(media: DataFrame, tensors: bool = True) -> DataFrame:
    """A row per row of (doc_id, n_bytes, media): what the stored bytes hold, and with ``tensors`` height, width and rgb (rows, columns, channels of unsigned bytes)."""
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read(tensors), kinds + (", height long, width long, rgb binary" if tensors else ""))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(stored(C.table(spark, sf_dir, "documents")), tensors=False)


SQL: dict[str, str] = {}
