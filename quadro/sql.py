"""SQL over records: Spark's own, with the result cut at a stated number of rows."""

from __future__ import annotations

import re
import unicodedata
import zlib

from pyspark.sql import DataFrame, SparkSession

SHOWN = 5000


def safe_name(name: str) -> str:
    """A view's name from a file's: letters and digits, t_ before, 60 characters at most.
    Where letters of other scripts are lost, a number tells such names apart."""
    plain = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c)).lower()
    mark = f"_{zlib.crc32(name.encode()):08x}" if re.search(r"[^\W\da-z_]", plain) else ""
    return ("t_" + re.sub(r"[^a-z0-9]+", "_", plain).strip("_"))[: 60 - len(mark)] + mark


def register(df: DataFrame, name: str) -> str:
    view = safe_name(name)
    df.createOrReplaceTempView(view)
    return view


def run_sql(spark: SparkSession, text: str, shown: int = SHOWN) -> tuple[DataFrame, bool]:
    """(the first `shown` rows, whether there are more), for showing: the statement runs once."""
    found = spark.sql(text)
    rows = found.limit(shown + 1).collect()  # bounded
    return spark.createDataFrame(rows[:shown], found.schema), len(rows) > shown


def export_sql(spark: SparkSession, text: str, path: str, form: str = "parquet") -> None:
    """The full result as Parquet (zstd) or CSV (semicolons)."""
    out = spark.sql(text).write
    if form == "parquet":
        out.option("compression", "zstd").parquet(path)
    elif form == "csv":
        out.csv(path, sep=";", header=True)
    else:
        raise ValueError(f"no form {form}")
