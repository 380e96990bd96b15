"""Rows in a total order without one task that sees them all.

Rows are dealt to ranges of the order, sorted within each, and written with their place.
What must pass from range to range is one small row for each of them (a count, a smallest
value), and these rows, at most `spark.sql.shuffle.partitions`, are folded and sent back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadro.sources.scratch import scratch_path

#: monotonically_increasing_id() is the partition's number times this, plus the place in it.
PLACES = 1 << 33
RANGE, PLACE = "_range", "_place"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: later readers see the same rows in the same order."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """df, written, with the range that each row is in and its place there (from 0).

    Rows equal in order are told apart by a hash of the row, so that a value on many rows is
    spread over ranges; rows equal in every column stay in one range.
    """
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    by = [*order, F.xxhash64(*hashable).asc()] if hashable else list(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_range_id", F.monotonically_increasing_id())
    return written(d.withColumns({RANGE: F.col("_range_id").bitwiseAND(F.lit(-PLACES)), PLACE: F.col("_range_id").bitwiseAND(F.lit(PLACES - 1))}).drop("_range_id"), "ranges")


def before(ranges: DataFrame, fold: dict[str, tuple[Column, Column]], backwards: bool = False) -> DataFrame:
    """For each range what the ranges before it (backwards: after it) hold, one row a range.

    fold: by name, an aggregate over a range's rows and the aggregate, over a column of that
    name, that joins several of them."""
    each = ranges.groupBy(RANGE).agg(*[a.alias(k) for k, (a, _) in fold.items()])
    w = Window.orderBy(F.col(RANGE).desc() if backwards else F.col(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    return each.select(RANGE, *[joined.over(w).alias(k) for k, (_, joined) in fold.items()])


def numbered(df: DataFrame, order: Sequence[Column], name: str = "ordinal") -> DataFrame:
    """df and each row's number (from 0) in the order; no task sees more than a range of it."""
    d = in_ranges(df, order)
    start = before(d, {"_start": (F.count(F.lit(1)), F.sum("_start"))})
    return d.join(F.broadcast(start), RANGE).select(*[F.col(f"`{c}`") for c in df.columns], (F.coalesce("_start", F.lit(0)) + F.col(PLACE)).alias(name))


def lagged(df: DataFrame, order: Sequence[Column], lags: dict[str, tuple[str, int]]) -> DataFrame:
    """df and, by new name, a column's value so many rows earlier in the order (later if negative).

    Rows meet by their numbers, so any distance costs the same and nothing is skewed. The first
    rows have null. An offset of 0 is the row itself."""
    d = written(numbered(df, order, "_ordinal"), "numbered") if lags else df
    out = d
    for offset in sorted({n for _, n in lags.values()}):
        held = d.select((F.col("_ordinal") + offset).alias("_ordinal"), *[F.col(f"`{c}`").alias(name) for name, (c, n) in lags.items() if n == offset])
        out = out.join(held, "_ordinal", "left")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[F.col(f"`{name}`") for name in lags])


def limited(df: DataFrame, limit: int, order: Sequence[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """The first `limit` records in order, and one row of counters: seen, kept, truncated.

    Without an order: as the source holds them (by file, then by place in it), or, for rows that
    come from no file, as their partitions do. limit must be 0 or more."""
    if limit < 0:
        raise ValueError("a limit is 0 or more")
    d = numbered(df, order, "_ordinal") if order is not None else source_numbered(df, "_ordinal")
    seen = d.agg(F.count(F.lit(1)).alias("seen"))
    counters = seen.select("seen", F.least("seen", F.lit(limit).cast("long")).alias("kept"), (F.col("seen") > limit).alias("truncated"))
    return d.where(F.col("_ordinal") < limit).drop("_ordinal"), counters


def source_numbered(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """df and each record's number (from 0) in the order of its source.

    A file's rows are counted by file and number their own places; the counts, one row a file,
    are added up in order of paths and sent to every task: a join by file would put all rows of a
    file into one task. Nothing is sorted and no row is moved. Rows that a filter has left of
    their files are dealt to ranges of that order instead."""
    try:
        d = df.select("*", F.col("_metadata.file_path").alias(RANGE), F.col("_metadata.row_index").alias(PLACE))
    except AnalysisException:  # rows of no file, or of a format that doesn't number its rows
        d = written(df.withColumn("_range_id", F.monotonically_increasing_id()), "rows")
        d = d.withColumns({RANGE: F.col("_range_id").bitwiseAND(F.lit(-PLACES)), PLACE: F.col("_range_id").bitwiseAND(F.lit(PLACES - 1))}).drop("_range_id")
    each = d.groupBy(RANGE).agg((F.count(F.lit(1)) == F.max(PLACE) + 1).alias("whole"))
    if each.agg(F.every("whole")).first()[0] is False:
        return numbered(d, [F.col(RANGE), F.col(PLACE)], name).drop(RANGE, PLACE)
    start = before(d, {"_start": (F.count(F.lit(1)), F.sum("_start"))})
    return d.join(F.broadcast(start), RANGE).select(*[F.col(f"`{c}`") for c in df.columns], (F.coalesce("_start", F.lit(0)) + F.col(PLACE)).alias(name))
