"""Tabulations, distinct values and flows over a stream: the same aggregations, kept by
Structured Streaming. A snapshot in complete mode equals the batch over what has arrived."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadro.functions.coerce import as_key, kind_of, to_number, trim_all
from quadro.operators.profiling import profile_of_counts, values_read
from quadro.operators.tabulate import _key, _measure, accepted, prepared
from quadro.plans.spec import TabulationSpec, compile_plan
from quadro.streaming import versions


def running_cells(stream: DataFrame, spec: TabulationSpec) -> DataFrame:
    """row_key, col_key and the measures of what has arrived (cells that occur)."""
    compile_plan(spec, stream.columns)
    d = prepared(stream, spec, {})
    keys = [_key(d, spec.rows, {}).alias("row_key"), (_key(d, spec.columns, {}) if spec.columns else F.lit("0")).alias("col_key")]
    return d.where(accepted(d, spec, {})).groupBy(*keys).agg(*[_measure(d, m).alias(f"m{k}") for k, m in enumerate(spec.measures)])


def running_distinct(stream: DataFrame, name: str) -> DataFrame:
    return stream.select(as_key(F.col(name), kind_of(stream, name)).alias("value")).where("value is not null").dropDuplicates(["value"])


def running_flows(stream: DataFrame, origin: str, destination: str, weight: str | None = None) -> DataFrame:
    """origin, destination, value, records of what has arrived; blanks, and weights that are no
    numbers, are left out."""
    text = lambda n: trim_all(as_key(F.col(n), kind_of(stream, n)))
    blank = F.lit(False) if weight is None else F.col(weight).isNull() | (F.trim(F.col(weight).cast("string")) == "")
    w = F.lit(1.0) if weight is None else F.when(blank, 0.0).otherwise(to_number(F.col(weight), kind_of(stream, weight)))
    d = stream.select(text(origin).alias("origin"), text(destination).alias("destination"), w.alias("value"))
    return d.where("origin <> '' and destination <> '' and value is not null").groupBy("origin", "destination").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("records"))


def running_combinations(stream: DataFrame, names: Sequence[str]) -> DataFrame:
    """names, records: the combinations of values that have arrived, absent ones as empty texts."""
    keys = [F.coalesce(as_key(F.col(n), kind_of(stream, n)), F.lit("")).alias(n) for n in names]
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))


def windowed_counts(stream: DataFrame, time: str, key: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts by window and key. Written by write_updates(), windows leave the state once the
    watermark has passed them."""
    kind = kind_of(stream, time)
    d = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return d.groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").cast(kind).alias("start"), key, "n")


def _started(writer, once: bool) -> StreamingQuery:  # noqa: ANN001
    return (writer.trigger(availableNow=True) if once else writer).start()


#: Snapshots kept: the newest, and the one that a reader may have begun.
KEPT = 2


def write_snapshots(cells: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch writes a snapshot of its own under `path`, which readers see once it is whole."""
    def put(d: DataFrame, batch: int) -> None:
        versions.write(d, path, batch)
        versions.drop(d.sparkSession, path, versions.batches(d.sparkSession, path)[:-KEPT])

    return _started(cells.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put), once)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole snapshot."""
    return versions.read(spark, path, versions.batches(spark, path)[-1:]).drop("_batch")


def write_updates(cells: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch writes the rows that it changed; state that a watermark has passed is dropped."""
    put = lambda d, batch: versions.write(d, path, batch)
    return _started(cells.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put), once)


def read_updates(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The last form of each row, by its keys."""
    d = versions.read(spark, path, versions.batches(spark, path))
    rest = [c for c in d.columns if c not in (*keys, "_batch")]
    last = d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last"))
    return last.select(*keys, "_last.*")


#: Batches of counts that are read one by one before they are added up.
ADDED_UP = 16


def write_profile(stream: DataFrame, name: str, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps what a numeric profile of all that has arrived needs: how often each value occurs.

    A batch writes the counts of its own values; every ADDED_UP batches these and the sum before
    them become one sum. A batch that runs again after a crash replaces what it wrote, so it
    counts once."""
    def put(d: DataFrame, batch: int) -> None:
        spark = d.sparkSession
        versions.write(values_read(d, name).groupBy("v", "blank").agg(F.count(F.lit(1)).alias("n")), path, batch)
        if batch % ADDED_UP == ADDED_UP - 1:
            before = [b for b in versions.batches(spark, path, "sum") if b < batch]
            versions.write(_counts(spark, path, batch), path, batch, "sum")
            # The sum before this one stays for readers that have begun, and for this batch if it runs again.
            versions.drop(spark, path, before[:-1], "sum")
            versions.drop(spark, path, [b for b in versions.batches(spark, path) if before and b <= before[-1]])

    return _started(stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put), once)


def _counts(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The counts of all batches (up to one): of the newest sum before it, and of those after that sum."""
    sums = [b for b in versions.batches(spark, path, "sum") if batch is None or b < batch]
    own = [b for b in versions.batches(spark, path) if (not sums or b > sums[-1]) and (batch is None or b <= batch)]
    parts = [versions.read(spark, path, b, kind).select("v", "blank", "n") for b, kind in ((sums[-1:], "sum"), (own, "batch")) if b]
    return reduce(DataFrame.unionByName, parts).groupBy("v", "blank").agg(F.sum("n").alias("n"))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """The numeric profile of all whole batches: as profiling.numeric_profile() of their records."""
    return profile_of_counts(_counts(spark, path))
