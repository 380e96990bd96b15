"""Large files read in byte ranges: Spark lists the files, tasks open them and seek."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a range, about.
RANGE_BYTES = 32 << 20
#: Tasks of one read at most; each may take several ranges.
MOST_TASKS = 100_000


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, length of all files under a path; their contents aren't read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def opened(path: str) -> pa.NativeFile:
    if path.startswith("file:") or ":" not in path.split("/")[0]:  # Spark's paths of files aren't encoded
        return LocalFileSystem().open_input_file(re.sub(r"^file:/+", "/", path))
    system, inner = FileSystem.from_uri(path)
    return system.open_input_file(inner)


def seekable(path: str) -> bool:
    """Whether tasks can open a path on their own; some stores only Spark reads."""
    try:
        with opened(path):
            return True
    except (pa.ArrowException, OSError, ValueError):
        return False


def split(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """files with part and parts: a row for each range of at least one file, dealt to tasks evenly."""
    d = files.withColumn("parts", _parts(size)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return d.repartition(tasks(files, size))


def _parts(size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.col("length") / size)).cast("int")


def tasks(files: DataFrame, size: int) -> int:
    """One for each range; where ranges are small and many, one for RANGE_BYTES of them."""
    ranges, length = files.agg(F.sum(_parts(size)), F.sum("length")).first()
    few = max(16 * files.sparkSession.sparkContext.defaultParallelism, (length or 0) // RANGE_BYTES)
    return min(MOST_TASKS, few, ranges or 1)
