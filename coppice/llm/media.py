"""Media columns: payloads stored in progressive JPEG files, read back as RGB tensors.

``to_media`` turns texts (or ``to_media_bytes`` any payload) into a column of
JPEG files; ``from_media`` reads such a column, or any progressive JPEG, into
full-resolution tensors.  Both are one Arrow pass without a shuffle and hold one
document at a time beside the batch.

Null and empty texts are a payload of padding only; repeated rows give equal
values; a null or unreadable file gives null columns rather than an error.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from coppice.llm import jpeg
from coppice.llm.common import arrow_map, table
from coppice.session import spread

PAD_TO = 576
PAD = b"\xff"


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes and their count; 255s up to a positive multiple of ``PAD_TO``."""
    data = (text or "").encode()
    return len(data), data + PAD * (-len(data) % PAD_TO if data else PAD_TO)


def to_media(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Columns id, n_bytes and media, the JPEG file that holds the padded text."""

    def store(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, files = [], []
        for value in batch.column(1).to_pylist():
            n, payload = padded(value)
            sizes.append(n)
            files.append(jpeg.encode(payload))
        arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, [id_col, "n_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(id_col, text), store, f"`{id_col}` {kind}, n_bytes long, media binary")


def from_media(df: DataFrame, media: str = "media") -> DataFrame:
    """All columns of ``df`` plus height, width and rgb (uint8, row by row); nulls where it can't be read."""
    at = df.columns.index(media)

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = []
        for data in batch.column(at).to_pylist():
            try:
                found.append(jpeg.to_rgb(jpeg.Image(data)) if data else None)
            except (ValueError, IndexError, KeyError, StopIteration):
                found.append(None)
        arrays = [*batch.columns]
        arrays += [pa.array([None if x is None else x.shape[k] for x in found], pa.int32()) for k in (0, 1)]
        arrays.append(pa.array([None if x is None else x.tobytes() for x in found], pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, names)

    names = [*df.columns, "height", "width", "rgb"]
    columns = ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes)
    return arrow_map(df, read, f"{columns}, height int, width int, rgb binary")


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the stored files back and describe what was in them."""

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data in batch.column(2).to_pylist():
            image = jpeg.Image(data)
            payload = jpeg.payload_of(image)
            rows.append(
                (
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-32:]),
                    len(data),
                    hashlib.sha256(data).hexdigest(),
                    feature(jpeg.to_rgb(image)),
                )
            )
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        arrays = [batch.column(0), batch.column(1)]
        arrays += [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = df.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )
    return arrow_map(df.select(id_col, "n_bytes", "media"), describe, schema)


def feature(rgb: np.ndarray) -> str:
    """Shape, channel means to a hundredth and a checksum of the tensor."""
    height, width, _ = rgb.shape
    means = rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 100 // (height * width)
    return f"{height}x{width} " + " ".join(f"{m // 100}.{m % 100:02d}" for m in means.tolist()) + f" {zlib.crc32(rgb):08x}"


def op8_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(to_media(spread(table(spark, sf_dir, "documents"))))
