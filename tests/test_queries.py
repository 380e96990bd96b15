"""Every registered query against its SQL in DuckDB."""

import pytest
from oracle import connect, rows_of

import quadro.queries_scale  # noqa: F401
import quadro.queries_tables  # noqa: F401
from quadro.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
