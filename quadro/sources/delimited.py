"""Delimited text with a header, read in byte ranges and typed by its own rules.

A column is numeric only if every populated value is; a leading zero keeps a code a text;
a decimal comma is read only where semicolons separate; blanks are null. One pass over
the texts decides all types.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadro.plans.spec import PlanError
from quadro.sources.ranges import RANGE_BYTES, listed, opened, seekable, split, tasks

DELIMITERS = (",", ";", "\t")


def sniff(header: str) -> str:
    """The delimiter that a header line has most of, outside quotes; a tie is an error."""
    counts, quoted = dict.fromkeys(DELIMITERS, 0), False
    for c in header:
        if c == '"':
            quoted = not quoted
        elif not quoted and c in counts:
            counts[c] += 1
    most = max(counts.values())
    found = [d for d, n in counts.items() if n == most]
    if most and len(found) > 1:
        raise PlanError(f"can't tell the delimiter of {header!r}")
    return found[0] if most else ","


def column_names(names: list[str]) -> list[str]:
    """Blank names become COLUNA_n; names that repeat, whatever their case, are an error."""
    out = [(n or "").strip().lstrip("﻿") or f"COLUNA_{k + 1}" for k, n in enumerate(names)]
    if len({n.lower() for n in out}) < len(out):
        raise PlanError("a column name repeats")
    return out


def _number(c: Column, comma: bool) -> Column:
    return F.regexp_replace(c, ",", ".") if comma else c


def _numeric(c: Column, comma: bool) -> Column:
    mark = "[.,]" if comma else r"\."
    return c.rlike(rf"^[+-]?\d+({mark}\d+)?$") & ~c.rlike(r"^[+-]?0\d")


CELL_STARTS = b"\r\n"


def _flips(data: bytes, state: int, sep: int) -> tuple[list[int], int, bool]:
    """Where quoting begins and ends in data[1:-1], the state after it, and whether something other
    than space follows a closing quote. data has the byte before and the byte after as well.

    States: 0 outside quotes, 1 inside, 2 inside, and the next byte is the second of a doubled
    quote. A quote opens only at the start of a cell; elsewhere outside it is a character."""
    flips, bad, skip, quote = [], False, 1 if state == 2 else -1, 0x22
    state = min(state, 1)
    for i in np.flatnonzero(np.frombuffer(data, np.uint8)[1:-1] == quote).tolist():
        i += 1
        if i == skip:
            continue
        if state:
            if data[i + 1] == quote:
                skip = i + 1
                continue
            bad |= data[i + 1] != sep and not data[i + 1 : i + 2].isspace()
            flips.append(i)
            state = 0
        elif data[i - 1] == sep or data[i - 1] in CELL_STARTS:
            flips.append(i)
            state = 1
    return flips, 2 if skip == len(data) - 1 else state, bad


def _around(f: pa.NativeFile, a: int, z: int, size: int) -> bytes:
    """Bytes a to z of a file with one more on each side; line ends stand for what lies beyond the file."""
    f.seek(max(0, a - 1))
    data = f.read(min(size, z + 1) - max(0, a - 1))
    return (b"" if a else b"\n") + data + (b"" if z < size else b"\n")


def _line_start(f: pa.NativeFile, a: int, state: int, sep: int, size: int) -> int:
    """The first line start at or after a, whose state is given; the file's size if there is none."""
    step = 1 << 16
    while a < size:
        z = min(size, a + step)
        data = _around(f, a, z, size)
        flips, after, _ = _flips(data, state, sep)
        edges = np.array([0, *flips, len(data)])
        codes = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero((codes[:-1] == 10) | (codes[:-1] == 13) & (codes[1:] != 10))
        outside = (np.searchsorted(edges, ends, side="right") - 1) % 2 == (state > 0)
        if outside.any() and (at := a + int(ends[outside][0])) < size:
            return at
        a, state, step = z, after, step * 2
    return size


def _states(files: DataFrame, sep: str, size: int) -> DataFrame:
    """path, begin, end, state (at its begin), next_state of each range of each file.

    Each range says what it makes of every state it might begin in; these answers, a few numbers
    a range, are folded along the file. Read once, without parsing."""
    mark = ord(sep)

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, part, parts in zip(*(b.column(c).to_pylist() for c in ("path", "length", "part", "parts")), strict=True):
                a, z = length * part // parts, length * (part + 1) // parts
                with opened(path) as f:
                    data = _around(f, a, z, length)
                ends = [_flips(data, s, mark)[1] for s in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([part], pa.int32()), pa.array([a]), pa.array([z]), pa.array([ends], pa.list_(pa.int32()))], ["path", "part", "begin", "end", "ends"])

    d = split(files, size).select("path", "length", "part", "parts").mapInArrow(answers, "path string, part int, begin bigint, end bigint, ends array<int>")
    line = d.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "begin", "end", "ends"))).alias("all"))
    none = F.expr("cast(array() as array<int>)")
    fold = F.aggregate("all", F.struct(none.alias("at"), F.lit(0).alias("now")), lambda s, r: F.struct(F.array_append(s["at"], s["now"]).alias("at"), F.get(r["ends"], s["now"]).alias("now")))
    d = line.select("path", "all", fold.alias("f")).select("path", F.posexplode("all").alias("k", "r"), F.array_append("f.at", F.col("f.now")).alias("at"))
    return d.select("path", "r.begin", "r.end", F.get("at", F.col("k")).alias("state"), F.get("at", F.col("k") + 1).alias("next_state"))


def _in_ranges(spark: SparkSession, files: DataFrame, names: list[str], sep: str, size: int, encoding: str) -> DataFrame:
    """The rows of all files as texts. A range takes the lines that begin in it."""
    mark = ord(sep)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, begin, end, state, after in zip(*(b.column(c).to_pylist() for c in ("path", "begin", "end", "state", "next_state")), strict=True):
                with opened(path) as f:
                    length = f.size()
                    if end == length and after:
                        raise PlanError(f"{path}: a quoted field isn't closed")
                    a = begin if begin == 0 else _line_start(f, begin, state, mark, length)
                    z = _line_start(f, end, after, mark, length)
                    if a >= z:
                        continue
                    data = _around(f, a, z, length)
                    if _flips(data, 0, mark)[2]:
                        raise PlanError(f"{path}: characters after a closing quote")
                    data = data[1:-1] if z < length else data[1:]
                    if begin == 0:
                        data = data.removeprefix(b"\xef\xbb\xbf")
                yield from _rows(path, data, names, sep, encoding, begin == 0)

    return _states(files, sep, size).repartition(tasks(files, size)).mapInArrow(parsed, T.StructType([T.StructField(n, T.StringType()) for n in names]))


def _rows(path: str, data: bytes, names: list[str], sep: str, encoding: str, header: bool) -> Iterator[pa.RecordBatch]:
    read = pacsv.ReadOptions(column_names=names, skip_rows_after_names=int(header), block_size=len(data) + 1, encoding=encoding, use_threads=False)
    parse = pacsv.ParseOptions(delimiter=sep, newlines_in_values=True)
    convert = pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False)
    try:
        yield from pacsv.read_csv(BytesIO(data), read, parse, convert).to_batches(max_chunksize=10_000)
    except pa.ArrowInvalid as e:
        raise PlanError(f"{path}: {e}") from None


def _first_line(path: str) -> str:
    """The header, which may hold line ends in quotes."""
    with opened(path) as f:
        text, more = b"", f.read(1 << 16)
        while more:
            text += more
            quoted = False
            for k, c in enumerate(text):
                if c == 0x22:
                    quoted = not quoted
                elif not quoted and c in CELL_STARTS:
                    return text[:k].decode("utf-8", "replace").lstrip("﻿")
            more = f.read(1 << 16)
    return text.decode("utf-8", "replace").lstrip("﻿")


def read_delimited(spark: SparkSession, path: str, delimiter: str | None = None, range_bytes: int = RANGE_BYTES, encoding: str = "utf8") -> DataFrame:
    """The files with their columns typed. A row of another width, a file without data rows, an
    open quote at the end and text after a closing quote are errors.

    Files are read in ranges of about range_bytes by tasks of their own, line ends in quotes
    included: see _states(). A store that only Spark reads is read by its own reader, a file a task.
    """
    files = listed(spark, path).where("length > 0")
    heads = files.orderBy("path").limit(1).collect()
    if not heads:
        raise PlanError(f"{path} is empty")
    first = heads[0]["path"]
    if seekable(first):
        header = _first_line(first)
        sep = delimiter or sniff(header)
        own = next(csv.reader([header], delimiter=sep), [])
        d = _in_ranges(spark, files, column_names(own), sep, range_bytes, encoding)
    else:
        sep = delimiter or sniff(spark.read.text(path).limit(1).collect()[0][0].lstrip("﻿"))
        reader = spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("inferSchema", False)
        names = reader.option("mode", "PERMISSIVE").csv(path).columns
        own = [n if not n.startswith("_c") or not n[2:].isdigit() else "" for n in names]  # Spark numbers names that are blank or repeat
        d = reader.option("mode", "FAILFAST").csv(path).toDF(*column_names(own))
    blank_free = d.select(*[F.when(F.trim(F.col(c)) != "", F.trim(F.col(c))).alias(c) for c in d.columns])
    comma = sep == ";"
    kinds = blank_free.agg(F.count(F.lit(1)).alias("_rows"), *[(F.coalesce(F.min(_numeric(F.col(c), comma)), F.lit(False))).alias(c) for c in d.columns]).first()
    if not kinds["_rows"]:
        raise PlanError(f"{path} has no data rows")
    return blank_free.select(*[_number(F.col(c), comma).cast("double").alias(c) if kinds[c] else F.col(c) for c in d.columns])
