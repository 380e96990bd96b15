"""What the operators share: reading tables, cutting lineage, word patterns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and the words it separates.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Settings of a write whose tasks send whole texts to Python: memory follows these rows.
SHORT_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode
    (tests) a folder of this machine where that is unset. A cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:  # not a setting that a running session takes: remembered here
        found = _own.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="quadro-shared-")
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session settings that hold for the jobs run within."""
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def stage(df: DataFrame, name: str, settings: dict[str, str] | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    This cuts the lineage as a checkpoint does, but later readers prune columns,
    and a lost executor costs a re-read instead of a recomputation. Nothing reads the
    write's shuffle files again: Spark is told to drop them when it ends.

    settings: session settings that hold for this write.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with held(spark, {DROP_SHUFFLES: "true"} | (settings or {})):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """A text, or the empty text for null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c, F.lit(""))


def word_count(column: str | Column) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")
