"""Media columns: texts stored losslessly in progressive JPEG files and read back.

store() gives each row's file; measure() reads the files, takes the payload out of the
coefficient arrays, turns these into full-resolution RGB and returns features; tensors()
returns the RGB itself. All three work row by row within tasks, without a shuffle.

Defined cases: a null text is empty; an empty text is 64 bytes 0; texts of any length
are stored whole (a file holds up to 6 GB); equal texts give equal files and features;
an empty table gives an empty table; columns other than the key and the text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadro.llm import jpeg

UNIT = 64


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and these with bytes 0 up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def _schema(df: DataFrame, key: str, **more: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(key, df.schema[key].dataType), *[T.StructField(k, v) for k, v in more.items()]])


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes (of the text), media (the file)."""
    schema = _schema(docs, key, n_bytes=T.LongType(), media=T.BinaryType())

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = [(n, jpeg.encode(p)) for n, p in (padded(t.as_py()) for t in part.column(text))]
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=schema.names)

    return docs.select(key, text).mapInArrow(one, schema)


def measure(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    schema = _schema(files, key, n_bytes=T.LongType(), payload_bytes=T.LongType(), payload_sha256=T.StringType(), tail_crc32=T.LongType(), media_bytes=T.LongType(), media_sha256=T.StringType(), feature=T.StringType())

    def digest(media: bytes) -> tuple:
        pic = jpeg.decode(media)
        payload = jpeg.payload_of(pic)
        sums, edges = np.zeros(3, np.int64), 0
        for slab in jpeg.slabs(pic):
            sums += slab.reshape(-1, 3).sum(axis=0, dtype=np.int64)
            edges += int((slab[:, 1:, 1] > slab[:, :-1, 1]).sum())
        means = sums / (pic.height * pic.width)
        feature = f"{pic.width}x{pic.height} rgb {means[0]:.1f} {means[1]:.1f} {means[2]:.1f} rising {edges / (pic.height * (pic.width - 1)):.3f}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [digest(m.as_py()) for m in b.column("media")]
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("n_bytes"), *arrays], names=schema.names)

    return files.mapInArrow(one, schema)


def tensors(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, height, width, rgb (height * width * 3 bytes, row by row)."""
    schema = _schema(files, key, height=T.IntegerType(), width=T.IntegerType(), rgb=T.BinaryType())

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, m in zip(b.column(key), b.column("media"), strict=True):
                picture = jpeg.rgb(jpeg.decode(m.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], b.column(key).type), pa.array([picture.shape[0]], pa.int32()), pa.array([picture.shape[1]], pa.int32()), pa.array([picture.tobytes()], pa.binary())], names=schema.names)

    return files.select(key, "media").mapInArrow(one, schema)
