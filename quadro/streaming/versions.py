"""Tables that a stream leaves behind, by batch: written whole, then seen.

A batch's folder counts once Spark has marked it as done (_SUCCESS), so a reader never meets
half of it, and a batch that runs again after a crash replaces its own folder only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _store(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _folder(path: str, kind: str, batch: int) -> str:
    return f"{path}/{kind}-{batch:012}"


def batches(spark: SparkSession, path: str, kind: str = "batch") -> list[int]:
    """The batches of a kind that are there as a whole, in order."""
    store, p = _store(spark, path)
    if not store.exists(p):
        return []
    names = [f.getPath().getName() for f in store.listStatus(p) if f.isDirectory()]
    found = sorted(int(n.rpartition("-")[2]) for n in names if n.rpartition("-")[0] == kind)
    return [b for b in found if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{_folder(path, kind, b)}/_SUCCESS"))]


def write(d: DataFrame, path: str, batch: int, kind: str = "batch") -> None:
    d.write.mode("overwrite").parquet(_folder(path, kind, batch))


def read(spark: SparkSession, path: str, chosen: list[int], kind: str = "batch") -> DataFrame:
    """The rows of some batches, with `_batch`."""
    d = spark.read.parquet(*[_folder(path, kind, b) for b in chosen])
    return d.withColumn("_batch", F.regexp_extract(F.col("_metadata.file_path"), kind + r"-(\d+)/[^/]*$", 1).cast("long"))


def drop(spark: SparkSession, path: str, gone: list[int], kind: str = "batch") -> None:
    for b in gone:
        store, p = _store(spark, _folder(path, kind, b))
        store.delete(p, True)
