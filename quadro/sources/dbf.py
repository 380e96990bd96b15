"""DBF files (xBase tables) and DBC files (the same, compressed).

Spark lists the files; tasks read ranges of records and decode them by numpy, some at a
time, only the fields asked for.
"""

from __future__ import annotations

import datetime
import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadro.plans.spec import PlanError
from quadro.sources.ranges import RANGE_BYTES, listed, opened, seekable, split

BATCH = 50_000
#: Bytes of the records of a file that a task writes, at most.
FILE_BYTES = 16 << 20


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    length: int
    decimals: int
    start: int


@dataclass(frozen=True)
class Header:
    records: int
    size: int
    record: int
    fields: tuple[Field, ...]


def parse_header(data: bytes) -> Header:
    if len(data) < 33:
        raise PlanError("no DBF header")
    records, size, record = struct.unpack_from("<IHH", data, 4)
    fields, at, start = [], 32, 1
    while at < size - 1 and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1").strip()
        fields.append(Field(name, chr(data[at + 11]), data[at + 16], data[at + 17], start))
        start += data[at + 16]
        at += 32
    if start > record:
        raise PlanError("the fields are longer than a record")
    return Header(records, size, record, tuple(fields))


SPARK_TYPES = {"N": T.DoubleType(), "F": T.DoubleType(), "I": T.IntegerType(), "D": T.DateType(), "L": T.BooleanType()}


def schema_of(header: Header, fields: Sequence[str] | None = None) -> T.StructType:
    """Field lengths and decimals are kept as metadata."""
    chosen = _chosen(header, fields)
    return T.StructType([T.StructField(f.name, SPARK_TYPES.get(f.kind, T.StringType()), True, {"length": f.length, "decimals": f.decimals, "kind": f.kind}) for f in chosen])


def _chosen(header: Header, fields: Sequence[str] | None) -> list[Field]:
    known = {f.name: f for f in header.fields}
    if absent := [n for n in fields or () if n not in known]:
        raise PlanError(f"no field {', '.join(absent)}")
    return [known[n] for n in fields] if fields else list(header.fields)


def _column(raw: np.ndarray, f: Field, encoding: str) -> pa.Array:
    """One field of some records; raw: records by bytes."""
    part = np.ascontiguousarray(raw[:, f.start : f.start + f.length])
    if f.kind == "I":
        return pa.array(part.view("<i4").ravel())
    texts = _texts(part, encoding)
    if f.kind in "NF":
        try:
            numbers = np.array([float(t) for t in texts])
        except ValueError:  # blanks among them
            return pa.array([_float(t.strip()) for t in texts], pa.float64())
        return pa.array(numbers, pa.float64(), mask=~np.isfinite(numbers))
    if f.kind == "D":
        return pa.array([_date(t) for t in texts], pa.date32())
    if f.kind == "L":
        return pa.array([True if t in "TtYy" else False if t in "FfNn" else None for t in texts], pa.bool_())
    return pa.array([t.rstrip(" ") or None for t in texts], pa.string())


def _texts(part: np.ndarray, encoding: str) -> list[str]:
    """The texts of one field; at once where every character is a byte."""
    try:
        text, n = part.tobytes().decode(encoding), part.shape[1]
        if n and len(text) == part.size:
            return [text[k : k + n] for k in range(0, len(text), n)]
    except UnicodeDecodeError:  # a character may end in the next field
        pass
    return [bytes(x).decode(encoding) for x in part]


def _float(text: str) -> float | None:
    try:
        v = float(text)
    except ValueError:
        return None
    return v if np.isfinite(v) else None


def _date(text: str) -> datetime.date | None:
    try:
        return datetime.datetime.strptime(text, "%Y%m%d").date() if text.isdigit() else None
    except ValueError:
        return None


def _batch(rows: np.ndarray, chosen: list[Field], encoding: str, deleted: bool) -> pa.RecordBatch:
    """Some records (by bytes), deleted ones (marked *) only if asked for."""
    gone = rows[:, 0] == 0x2A
    if not deleted:
        rows = rows[~gone]
    arrays, names = [_column(rows, f, encoding) for f in chosen], [f.name for f in chosen]
    if deleted:
        arrays.append(pa.array(gone))
        names.append("__deleted")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def decode(data: bytes, fields: Sequence[str] | None, encoding: str, deleted: bool) -> Iterator[pa.RecordBatch]:
    """The records of one file."""
    h = parse_header(data)
    body = np.frombuffer(data, np.uint8, offset=h.size)
    _check_size(h, len(data))
    rows = body[: h.records * h.record].reshape(h.records, h.record)
    for a in range(0, h.records, BATCH):
        yield _batch(rows[a : a + BATCH], _chosen(h, fields), encoding, deleted)


def _check_size(h: Header, size: int) -> None:
    if not 0 <= size - h.size - h.records * h.record <= 1:
        raise PlanError("the file's size isn't that of its records")


def read_dbf(spark: SparkSession, path: str, fields: Sequence[str] | None = None, encoding: str = "cp1252", deleted: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All DBF or DBC files under a path. fields: the only ones to decode (a plan's
    fields_used()). All files need the same fields.

    A DBF file is read in ranges of records of about range_bytes, each by a task that seeks to
    them and holds BATCH records at a time. A DBC file is one compressed stream, so one task
    expands it; so are files of a store that only Spark reads."""
    files = listed(spark, path)
    first = files.orderBy("path").limit(1).collect()
    if not first:
        raise PlanError("no file")
    packed = F.lower("path").endswith(".dbc")
    if not seekable(first[0]["path"]) or first[0]["path"].lower().endswith(".dbc"):
        return dbf_records(spark.read.format("binaryFile").load(path).select("path", "content"), fields, encoding, deleted)
    with opened(first[0]["path"]) as f:
        header = parse_header(f.read(65536))
    schema = schema_of(header, fields)
    if deleted:
        schema = schema.add("__deleted", T.BooleanType())

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, part, parts in zip(*(b.column(c).to_pylist() for c in ("path", "part", "parts")), strict=True):
                with opened(name) as f:
                    h = parse_header(f.read(65536))
                    if h.fields != header.fields:
                        raise PlanError(f"{name}: its fields aren't those of the first file")
                    _check_size(h, f.size())
                    at, end = h.records * part // parts, h.records * (part + 1) // parts
                    f.seek(h.size + at * h.record)
                    while at < end:
                        n = min(BATCH, end - at)
                        yield _batch(np.frombuffer(f.read(n * h.record), np.uint8).reshape(n, h.record), _chosen(h, fields), encoding, deleted)
                        at += n

    plain = split(files.where(~packed), range_bytes).select("path", "part", "parts").mapInArrow(some, schema)
    if files.where(packed).isEmpty():
        return plain
    return plain.unionByName(dbf_records(spark.read.format("binaryFile").load(path).where(packed).select("path", "content"), fields, encoding, deleted))


def dbf_records(files: DataFrame, fields: Sequence[str] | None = None, encoding: str = "cp1252", deleted: bool = False) -> DataFrame:
    """The records of files given as path and content."""
    first = files.select(F.substring("content", 1, 65536).alias("head")).limit(1).collect()
    if not first:
        raise PlanError("no file")
    header = parse_header(bytes(first[0]["head"]))
    schema = schema_of(header, fields)
    if deleted:
        schema = schema.add("__deleted", T.BooleanType())

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                data = content.as_py()
                if name.lower().endswith(".dbc"):
                    data = expand_dbc(data)
                if parse_header(data).fields != header.fields:
                    raise PlanError(f"{name}: its fields aren't those of the first file")
                yield from decode(data, fields, encoding, deleted)

    return files.select("path", "content").mapInArrow(one, schema)


def _layout(schema: T.StructType, widths: dict[str, int] | None, decimals: dict[str, int] | None) -> tuple[list[Field], int]:
    """(fields of a file for these columns, bytes of a record)."""
    widths, decimals = widths or {}, decimals or {}
    fields, at = [], 1
    for f in schema.fields:
        number = isinstance(f.dataType, T.NumericType)
        kind = "N" if number else "D" if isinstance(f.dataType, T.DateType) else "L" if isinstance(f.dataType, T.BooleanType) else "C"
        length = {"D": 8, "L": 1}.get(kind) or widths.get(f.name) or f.metadata.get("length") or (20 if number else 254)
        fields.append(Field(f.name[:10], kind, length, decimals.get(f.name, f.metadata.get("decimals", 0)) if number else 0, at))
        at += length
    if len(fields) > 2046 or len({f.name for f in fields}) < len(fields):
        raise PlanError("too many fields, or names that are the same in ten letters")
    return fields, at


def _cell(v: object, f: Field) -> bytes:
    if v is None:
        return b" " * f.length if f.kind != "L" else b"?"
    if f.kind == "N":
        text = (f"{float(v):.{f.decimals}f}" if f.decimals else str(int(v))).rjust(f.length)
    elif f.kind == "D":
        text = v.strftime("%Y%m%d")
    elif f.kind == "L":
        text = "T" if v else "F"
    else:
        text = str(v).ljust(f.length)
    if len(text) > f.length:
        raise PlanError(f"{f.name}: {text.strip()!r} needs more than {f.length} characters")
    return text.encode("cp1252", "replace")


def _cells(values: list, f: Field) -> np.ndarray:
    """One field of some records, by bytes: what _cell() makes of each value."""
    if f.kind == "N":
        form, none = f"%{f.length}.{f.decimals}f" if f.decimals else f"%{f.length}d", " " * f.length
        texts = [none if v is None else form % v for v in values]
    elif f.kind == "C":
        texts = ["".ljust(f.length) if v is None else str(v).ljust(f.length) for v in values]
    else:
        return np.frombuffer(b"".join(_cell(v, f) for v in values), np.uint8).reshape(len(values), f.length)
    for v in (v for v, text in zip(values, texts, strict=True) if len(text) > f.length):
        _cell(v, f)  # raises
    return np.frombuffer("".join(texts).encode("cp1252", "replace"), np.uint8).reshape(len(values), f.length)


def _records(batch: pa.RecordBatch, fields: list[Field]) -> bytes:
    return np.hstack([np.full((batch.num_rows, 1), 0x20, np.uint8), *[_cells(c.to_pylist(), f) for c, f in zip(batch.columns, fields, strict=True)]]).tobytes()


def _packed(rows: Iterable[Sequence], fields: list[Field], record: int) -> bytes:
    return _file([b" " + b"".join(_cell(v, f) for v, f in zip(row, fields, strict=True)) for row in rows], fields, record)


def _file(body: list[bytes], fields: list[Field], record: int) -> bytes:
    """A DBF file of records as bytes; each item holds one or more of them."""
    size = sum(map(len, body))
    if size >= 1 << 31:
        raise PlanError("a DBF file has 2 GB at most")
    head = struct.pack("<BBBBIHH20x", 3, 99, 12, 31, size // record, 33 + 32 * len(fields), record)
    described = b"".join(f.name.encode("latin-1", "replace").ljust(11, b"\0") + f.kind.encode() + b"\0" * 4 + bytes([f.length, f.decimals]) + b"\0" * 14 for f in fields)
    return head + described + b"\r" + b"".join(body) + b"\x1a"


def write_dbf(df: DataFrame, widths: dict[str, int] | None = None, decimals: dict[str, int] | None = None) -> bytes:
    """A DBF file of a result (small by purpose: it is built on the driver, row by row).
    What a field can't hold is an error; characters outside Windows-1252 become ?."""
    return _packed(df.toLocalIterator(), *_layout(df.schema, widths, decimals))


def _pieces(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows of all batches, in order, `most` at a time."""
    held, n = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            held.append(b.slice(at, most - n))
            n += held[-1].num_rows
            at += held[-1].num_rows
            if n == most:
                yield held
                held, n = [], 0
    if held:
        yield held


def write_dbf_files(df: DataFrame, path: str, widths: dict[str, int] | None = None, decimals: dict[str, int] | None = None, most: int = 200_000, packed: bool = False) -> DataFrame:
    """file, records: a table of any size as DBF files of at most `most` records in a folder that
    executors share. Tasks write their own; one that is run again writes the same names. As
    with write_dbf, what a field can't hold is an error. A table without rows gives no file.
    A task holds one file as bytes, so a file ends at FILE_BYTES, too. packed: as DBC files."""
    fields, record = _layout(df.schema, widths, decimals)
    most = max(1, min(most, FILE_BYTES // record))
    out = T.StructType([T.StructField("file", T.StringType()), T.StructField("records", T.LongType())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, left = TaskContext.get().partitionId(), _pieces(batches, most)
        for k, some in enumerate(left):
            body = [_records(b, fields) for b in some]
            to, folder = FileSystem.from_uri(path) if ":" in path else (LocalFileSystem(), path)
            to.create_dir(folder)
            name = f"{folder}/part-{part:05}-{k:04}.{'dbc' if packed else 'dbf'}"
            with to.open_output_stream(name) as f:
                made = _file(body, fields, record)
                f.write(pack_dbc(made) if packed else made)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sum(b.num_rows for b in some)])], names=out.names)

    written = df.mapInArrow(write, out).collect()  # a row for each file
    return df.sparkSession.createDataFrame(written, out)


# --- the compression of DBC files (PKWARE DCL "implode") ----------------------------------

# Fixed values of the published format: run-length coded code lengths (count - 1 in the
# high four bits, length in the low four), and bases and extra bits of copy lengths.
LITERALS = (
    11, 124, 8, 7, 28, 7, 188, 13, 76, 4, 10, 8, 12, 10, 12, 10, 8, 23, 8, 9, 7, 6, 7, 8, 7, 6, 55, 8,
    23, 24, 12, 11, 7, 9, 11, 12, 6, 7, 22, 5, 7, 24, 6, 11, 9, 6, 7, 22, 7, 11, 38, 7, 9, 8, 25, 11,
    8, 11, 9, 12, 8, 12, 5, 38, 5, 38, 5, 11, 7, 5, 6, 21, 6, 10, 53, 8, 7, 24, 10, 27, 44, 253, 253, 253,
    252, 252, 252, 13, 12, 45, 12, 45, 12, 61, 12, 45, 44, 173,
)
LENGTHS, DISTANCES = (2, 35, 36, 53, 38, 23), (2, 20, 53, 230, 247, 151, 248)
BASES = (3, 2, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24, 40, 72, 136, 264)
EXTRA = (0, 0, 0, 0, 0, 0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8)
END = 519


LONGEST = 13  # bits of a code


def _by_bits(packed: Sequence[int]) -> list[int]:
    """For every next 13 bits, first bit lowest: 16 x the symbol whose code they start with and its
    bits (0: none). Codes are numbered by length and stored inverted."""
    lengths = [x & 15 for x in packed for _ in range((x >> 4) + 1)]
    found, code = [0] * (1 << LONGEST), 0
    for n in range(1, max(lengths) + 1):
        for symbol in (s for s, m in enumerate(lengths) if m == n):
            first = int(f"{code ^ ((1 << n) - 1):0{n}b}"[::-1], 2)
            found[first :: 1 << n] = [symbol << 4 | n] * (1 << LONGEST - n)
            code += 1
        code <<= 1
    return found


def explode(data: bytes) -> bytes:
    """Expands one imploded stream."""
    if len(data) < 3 or data[0] > 1 or not 4 <= data[1] <= 6:
        raise PlanError("no imploded data")
    literals, lengths, distances = (_by_bits(x) for x in (LITERALS, LENGTHS, DISTANCES))
    coded, bits_low = data[0], data[1]
    out, at, hold, held, mask = bytearray(), 2, 0, 0, (1 << LONGEST) - 1
    while True:
        if held < 64:  # a token has 43 bits at most
            hold |= int.from_bytes(data[at : at + 32], "little") << held
            at, held = at + 32, held + 256
            if at - 32 > len(data) + 32:
                raise PlanError("the data ends within a token")
        if not hold & 1:
            if coded:
                found = literals[hold >> 1 & mask]
                n = found & 15
                if not n:
                    raise PlanError("a code that isn't in the format")
                out.append(found >> 4)
            else:
                n = 8
                out.append(hold >> 1 & 255)
            hold >>= n + 1
            held -= n + 1
            continue
        found = lengths[hold >> 1 & mask]
        k, n = found >> 4, found & 15
        hold >>= n + 1
        size = BASES[k] + (hold & ((1 << EXTRA[k]) - 1))
        hold >>= EXTRA[k]
        held -= n + 1 + EXTRA[k]
        if size == END:
            if 8 * at - held > 8 * len(data):
                raise PlanError("the data ends within a token")
            return bytes(out)
        low = 2 if size == 2 else bits_low
        found = distances[hold & mask]
        n = found & 15
        back = (found >> 4 << low) + (hold >> n & ((1 << low) - 1)) + 1
        hold >>= n + low
        held -= n + low
        start = len(out) - back
        if start < 0:
            raise PlanError("a copy from before the start")
        if back >= size:
            out += out[start : start + size]
        else:  # a copy that reads what it writes
            out += (out[start:] * (size // back + 1))[:size]


def expand_dbc(data: bytes) -> bytes:
    """The DBF file in a DBC file: a header as it is, four bytes of checksum, the records."""
    size = struct.unpack_from("<H", data, 8)[0]
    return data[:size] + explode(data[size + 4 :])


def pack_dbc(data: bytes) -> bytes:
    """A DBF file as a DBC file. Its stream says each byte as it is: larger than the file by an
    eighth, which any reader of the format takes."""
    size = struct.unpack_from("<H", data, 8)[0]
    body = np.frombuffer(data, np.uint8, offset=size)
    bits = np.zeros((len(body), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(body, bitorder="little").reshape(-1, 8)
    end = np.array([1, *[0] * 7, *[1] * 8], np.uint8)  # a copy of END bytes
    return data[:size] + b"\0" * 4 + bytes([0, 4]) + np.packbits(np.concatenate([bits.ravel(), end]), bitorder="little").tobytes()
