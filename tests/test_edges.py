"""Quantiles, divisions, standardization, flows, maps, lookups and SQL at their edges."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadro import sql
from quadro.functions import coerce
from quadro.functions.formula import FormulaError, formula, references
from quadro.operators import predicates, profiling, statistics, tableops
from quadro.operators.tabulate import tabulate
from quadro.plans.spec import Category, CodeRange, Conversion, Dimension, Filter, TabulationSpec
from quadro.sources import definitions


@pytest.mark.parametrize("few", [False, True])
def test_quantiles_are_exact(spark, monkeypatch, few):
    """few: hardly anything may be sorted at once, so ranges are narrowed again and again."""
    if few:
        monkeypatch.setattr(statistics, "SORTED", 10)
        monkeypatch.setattr(statistics, "ACCURACY", 20)
    r, shares = random.Random(4), [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    for values in ([r.lognormvariate(0, 3) for _ in range(501)], [float(r.randrange(4)) for _ in range(300)], [7.0] * 40, [1.5], [1.0, 2.0], [-1e300, 0.0, 1e-300, 1e300]):
        d = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
        assert statistics.exact_quantiles(d, F.col("v"), shares) == pytest.approx(np.quantile(values, shares).tolist(), rel=1e-12)
    assert statistics.exact_quantiles(spark.createDataFrame([(None,)], "v double"), F.col("v"), [0.5]) == [None]


def test_outliers_of_a_flat_series_and_of_nothing(spark):
    d = spark.createDataFrame([(k, v) for k, v in enumerate([5.0] * 9 + [6.0])], "k int, v double")
    got = profiling.numeric_outliers(d, "v", ["k"]).collect()
    assert [(r.k, r.z, r.outside, r.score) for r in got] == [(9, 0.0, True, 33.0)]
    assert profiling.numeric_outliers(d.limit(0), "v", ["k"]).count() == 0


def test_shift_score_limits_the_sum(spark):
    side = lambda a, b: spark.createDataFrame([("x",)] * a + [("y",)] * b, "k string")
    got = profiling.distribution_shift(side(65, 35), side(30, 70), "k").first()
    assert (got.score, got.severity) == (79.0, "strong")
    assert profiling.distribution_shift(side(90, 10), side(40, 60), "k").first().score == 100.0


def value(spark, text, division="error", **row):
    d = spark.createDataFrame([tuple(map(float, row.values()))], ", ".join(f"{c} double" for c in row))
    return d.select(formula(text, {c: F.col(c) for c in row}, division=division).alias("x")).first()[0]


def test_division_policy_holds_for_named_ratios(spark):
    for text in ("RATE(a, b)", "PERCENT(a; b)", "RATIO(a, b)", "PCTCHANGE(a, b)", "a / b"):
        assert value(spark, text, "zero", a=4, b=0) == 0.0
        with pytest.raises(Exception, match="division by zero"):
            value(spark, text, a=4, b=0)
    assert value(spark, "RATE(a, b, 1000)", a=4, b=8) == 500.0
    assert value(spark, "PCTCHANGE(a, b)", a=6, b=8) == -25.0


def test_function_names_in_any_case(spark):
    assert value(spark, "if(and(a > 1; not(b > 1)); or(a = 0; b = 0); 7)", a=4, b=0) == 1.0
    assert value(spark, "If(a<1, 2, se(a=4; 3; 5))", a=4) == 3.0
    with pytest.raises(FormulaError):
        references("a + + ", ["a"])


def test_zscore_needs_no_window(spark):
    d = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "a double")
    z = d.select(formula("ZSCORE(a)", {"a": F.col("a")}, whole=d).alias("z"))
    assert "Window" not in z._jdf.queryExecution().executedPlan().toString()
    assert [r.z for r in z.collect()] == pytest.approx([(x - 3) / np.std([1, 2, 6], ddof=1) for x in (1, 2, 6)])


def test_standardization_checks_its_strata(spark):
    rows = lambda *x: spark.createDataFrame(list(x), "k string, e double, p double, s double")
    got = statistics.direct_standardization(rows(("a", 2.0, 100.0, 1.0), ("b", 1.0, 0.0, 1.0), ("c", 3.0, 50.0, 0.0)), "e", "p", "s", 100, "k").first()
    assert (got.rate, got.crude, got.used, got.skipped) == (2.0, 4.0, 1, 2)
    got = statistics.indirect_standardization(rows(("a", 2.0, 100.0, 1000.0), ("b", 1.0, 0.0, 5.0)), "e", "p", "s").first()
    assert (got.observed, got.expected, got.smr, got.used, got.skipped) == (3.0, 1.0, 3.0, 1, 1)
    for bad in (("a", 1.5, 1.0, 1.0), ("a", -1.0, 1.0, 1.0), ("a", None, 1.0, 1.0), ("a", 1.0, -1.0, 1.0), ("a", 1.0, 1.0, None)):
        for f in (statistics.direct_standardization, statistics.indirect_standardization):
            with pytest.raises(Exception, match=" in a"):
                f(rows(bad), "e", "p", "s", label="k").collect()


def test_flows_know_their_places(spark):
    d = spark.createDataFrame([("1", "2", "3,5"), ("1", "2", ""), ("1", "9", "1"), ("9", "9", "1"), ("", "9", "1"), ("1", None, "1"), ("2", "1", "x")], "o string, d string, w string")
    got = profiling.flow_counters(d, "o", "d", "w", ["1", "2"]).first().asDict()
    assert got == {"records": 7, "accepted": 2, "missing_origin": 1, "missing_destination": 1, "unknown_origin": 1, "unknown_destination": 2, "invalid_weight": 1}
    assert [tuple(r) for r in profiling.flows(d, "o", "d", "w", ["1", "2"]).collect()] == [("1", "2", 3.5, 2)]
    known = spark.createDataFrame([(1,), (2,)], "code int")
    assert [tuple(r) for r in profiling.flows(d, "o", "d", "w", known).collect()] == [("1", "2", 3.5, 2)]
    everything = profiling.ordered_flows(profiling.flows(d, "o", "d", "w", known, include_unknown=True)).collect()
    assert [(r.origin, r.destination, r.value) for r in everything] == [("1", "2", 3.5), ("1", "9", 1.0), ("9", "9", 1.0)]


def test_islands_and_holes(spark):
    box = lambda a, z: [[a, a], [z, a], [z, z], [a, z], [a, a]]
    shape = {"features": [{"geometry": {"type": "MultiPolygon", "coordinates": [[box(0, 2)], [box(10, 20), box(12, 14)]]}, "properties": {"c": "7", "n": "x"}}]}
    d, _ = definitions.read_geojson(spark, json.dumps(shape), "c", "n")
    points = spark.createDataFrame([(1.0,), (5.0,), (11.0,), (13.0,), (19.0,)], "p double")
    got = points.crossJoin(d).select("p", profiling.inside_parts(F.col("p"), F.col("p"), F.col("parts")).alias("in")).orderBy("p").collect()
    assert [r["in"] for r in got] == [True, False, True, False, True]


def test_lookup_keys_that_repeat(spark):
    d = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    spec = TabulationSpec(Dimension("k", lookup="t"))
    twice = spark.createDataFrame([("a", "A"), ("a", "A"), ("c", "C")], "key string, label string")
    assert {r.row_label: r.value for r in tabulate(d, spec, {"t": twice}).cells.collect()} == {"a A": 2.0, "c C": 0.0}
    with pytest.raises(Exception, match="two labels"):
        tabulate(d, spec, {"t": spark.createDataFrame([("a", "A"), ("a", "B")], "key string, label string")}).cells.collect()


def test_a_table_reads_its_records_once(spark):
    d = spark.range(100).select((F.col("id") % 7).cast("string").alias("r"), (F.col("id") % 3).cast("string").alias("c"))
    plan = tabulate(d, TabulationSpec(Dimension("r"), Dimension("c"), suppress_rows=True, suppress_columns=True)).cells._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan


def test_absent_cells_are_zero(spark):
    t = spark.createDataFrame([("a", "A", 0, 4.0, None), ("b", "B", 1, None, 2.0)], "row_key string, row_label string, ord int, x double, y double")
    assert [r.s for r in tableops.binary(t, "s", "add", "x", "y").orderBy("ord").collect()] == [4.0, 2.0]
    assert [r.s for r in tableops.unary(t, "s", "cumulative", "y").orderBy("ord").collect()] == [0.0, 2.0]


def test_filter_by_categories_of_a_conversion(spark):
    c = Conversion("c", (Category(1, "low"), Category(2, "high")), (CodeRange(1, "00", "09"), CodeRange(2, "10", "20")), code_length=2)
    d = spark.createDataFrame([("05",), ("15",), ("99",), (None,)], "v string")
    keep = lambda **k: [r[0] for r in d.where(predicates.matches(d, Filter("v", conversion=c, **k))).collect()]
    assert keep(categories=("2",)) == ["15"]
    assert keep(categories=("1",), include_unclassified=True) == ["05", "99", None]


def test_codes_and_local_numbers(spark):
    d = spark.createDataFrame([("3550308", "1.234,5"), ("35", "x"), ("11", "-2")], "c string, n string")
    got = d.select(coerce.belongs_to_state(F.col("c"), "35").alias("b"), coerce.local_number(F.col("n")).alias("n")).collect()
    assert [tuple(r) for r in got] == [(True, 1234.5), (True, None), (False, -2.0)]


def test_sql_results(spark, tmp_path):
    sql.register(spark.range(10), "Ação 2020.dbf")
    shown, more = sql.run_sql(spark, "SELECT id FROM t_acao_2020_dbf ORDER BY id", 3)
    assert ([r.id for r in shown.collect()], more) == ([0, 1, 2], True)
    assert sql.run_sql(spark, "SELECT id FROM t_acao_2020_dbf", 10)[1] is False
    assert sql.safe_name("表一") != sql.safe_name("表二")
    assert len(sql.safe_name("ж" * 90)) <= 60
    for form in ("parquet", "csv"):
        sql.export_sql(spark, "SELECT id, id * 2 AS b FROM t_acao_2020_dbf", str(tmp_path / form), form)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == spark.read.csv(str(tmp_path / "csv"), sep=";", header=True).count() == 10
