"""Compares a Spark result with DuckDB's for the same tables, whatever the order of rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(v: object) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return repr(round(float(v), 9) + 0.0)
    except (TypeError, ValueError):
        return str(v)


def rows_of(d: pd.DataFrame) -> list[tuple]:
    names = sorted(d.columns)
    return sorted(tuple(map(shown, r)) for r in d[names].itertuples(index=False))
