"""Archives and old worksheets: ZIP files expanded within limits, BIFF cells."""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quadro.plans.spec import PlanError

#: An archive that grows beyond these is refused: it isn't what it says.
MOST_PACKED, MOST_FILE, MOST_BYTES, MOST_ENTRIES, DEEPEST = 512 << 20, 512 << 20, 768 << 20, 5000, 2


@dataclass
class _Spent:
    """What an archive has expanded to so far, those within it included."""

    entries: int = 0
    size: int = 0


def entries(data: bytes, depth: int = 1, spent: _Spent | None = None) -> Iterator[tuple[str, bytes]]:
    """Names and contents of a ZIP, archives within it included; one budget covers them all."""
    if len(data) > MOST_PACKED:
        raise PlanError("the archive is too large")
    spent = spent or _Spent()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            spent.entries += 1
            if spent.entries > MOST_ENTRIES:
                raise PlanError("too many entries")
            if info.is_dir():
                continue
            inner = info.filename.lower().endswith(".zip") and depth < DEEPEST
            spent.size += 0 if inner else info.file_size
            if info.file_size > MOST_FILE or spent.size > MOST_BYTES:
                raise PlanError("the archive expands to too much")
            content = z.read(info)
            if inner:
                yield from entries(content, depth + 1, spent)
            else:
                yield info.filename, content


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file in the ZIP files under a path, expanded within tasks
    (for sources.dbf.dbf_records and others)."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                for name, data in entries(content.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["path", "content"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(one, "path string, content binary")


def parse_biff(data: bytes) -> dict[tuple[int, int], str | float]:
    """The texts and numbers of an old worksheet, by row and column."""
    cells: dict[tuple[int, int], str | float] = {}
    at = 0
    while at + 4 <= len(data):
        kind, size = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + size]
        if kind in (0x0203, 0x0204):
            row, column = struct.unpack_from("<HH", body)
            if kind == 0x0203:
                cells[row, column] = struct.unpack_from("<d", body, 6)[0]
            else:
                length = struct.unpack_from("<H", body, 6)[0]
                cells[row, column] = body[8 : 8 + length].decode("cp1252")
        at += 4 + size
    return cells
