"""How values are read, and what formulas, conversions and steps do at the edges."""

import datetime

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadro.functions import coerce
from quadro.functions.formula import FormulaError, formula
from quadro.operators import predicates, tabulate, transform
from quadro.plans.spec import Category, CodeRange, Conversion, Dimension, Filter, Measure, PlanError, Rule, TabulationSpec, compile_plan


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("value", "want"), [("1", 1.0), (" 1,5 ", 1.5), ("", None), (None, None), ("abc", None), ("1d", None), ("Infinity", None), ("1e3", 1000.0), (".5", 0.5), ("1,2,3", None), (" 7", 7.0)])
def test_to_number(spark, value, want):
    assert one(spark, coerce.to_number(F.col("v")), value) == want


@pytest.mark.parametrize(("value", "want"), [(1.0, "1"), (1e7, "10000000"), (123456789.5, "123456789.5"), (0.1, "0.1"), (-0.25, "-0.25"), (0.0, "0")])
def test_key_of_a_double(spark, value, want):
    assert one(spark, coerce.as_key(F.col("v"), T.DoubleType()), value, "double") == want


@pytest.mark.parametrize(("value", "want"), [("20240229", "2024-02-29"), ("20240231", None), ("31/12/1999", "1999-12-31"), ("1999-1-2", None), ("", None), (None, None)])
def test_dates(spark, value, want):
    got = one(spark, coerce.parse_date(F.col("v")), value)
    assert got == (datetime.date.fromisoformat(want) if want else None)


def test_blank_is_zero_in_ranges_and_exclude_is_the_complement(spark):
    d = spark.createDataFrame([(None,), ("",), ("  ",), ("5",), ("1,5",), ("abc",)], "v string")
    inside = d.where(predicates.matches(d, Filter("v", low=0, high=5)))
    outside = d.where(predicates.matches(d, Filter("v", "exclude", low=0, high=5)))
    assert inside.count() == 5
    assert [r[0] for r in outside.collect()] == ["abc"]


def test_natural_order(spark):
    d = spark.createDataFrame([(x,) for x in ("a10", "10", "9", "a2", "B1", "010")], "v string")
    assert [r[0] for r in d.orderBy(coerce.natural_key(F.col("v")), "v").collect()] == ["9", "010", "10", "a2", "a10", "B1"]


def test_labels_fold(spark):
    assert one(spark, coerce.fold_label(F.col("v")), "  São   PAULO ") == "sao paulo"


def test_municipalities(spark):
    for value, want in (("3550308", "355030"), ("355030", "355030"), ("12", "000012"), ("35503081", None), ("x", None)):
        assert one(spark, coerce.municipality_code(F.col("v")), value) == want


def test_epidemiological_weeks(spark):
    for day, want in (("2022-01-01", (2021, 52)), ("2022-01-02", (2022, 1)), ("2020-12-31", (2020, 53)), ("2021-01-03", (2021, 1))):
        d = F.col("v").cast("date")
        assert (one(spark, coerce.epi_year(d), day), one(spark, coerce.epi_week(d), day)) == want


def calc(spark, text, a=None, b=None, **options):
    d = spark.createDataFrame([(a, b)], "a double, b double")
    return d.select(formula(text, {"a": F.col("a"), "b": F.col("b")}, **options).alias("x")).first()[0]


@pytest.mark.parametrize(("text", "want"), [
    ("-2^2", -4), ("2^3^2", 512), ("1+2*3", 7), ("(1=1)+(1<>2)+(3>=4)", 2), ("=SOMA(a;b)", 5), ("MÉDIA(a,b)", 2.5), ("C01*C2", 6), ("[a]+[b]", 5), ("MEDIANA(5,1,3,2)", 2.5), ("ROUND(1.005,2)", 1.01),
    ("ROUND(-2.5)", -3), ("ROUNDUP(-1.21,1)", -1.3), ("TRUNC(-1.29,1)", -1.2), ("INT(-1.5)", -2), ("IFERROR(1/0;-1)", -1), ("ISNUMBER(LN(-1))", 0), ("IFS(a>5,1,b>2,2)", 2), ("LOG(8,2)", 3), ("E(1,0)+OU(1,0)+NAO(0)", 2),
    ("TAXA(1,4)", 25000), ("PCTCHANGE(b,a)", 50), ("COUNT(a,b,1/0)", 2)])
def test_formulas(spark, text, want):
    assert calc(spark, text, 2.0, 3.0) == pytest.approx(want)


@pytest.mark.parametrize("text", ["FOO(1)", "a +", "zzz", "SUM()", "IFS(1,2,3)", "a.b", "__import__('os')", "LAG(a+1)"])
def test_bad_formulas_are_refused(spark, text):
    with pytest.raises(FormulaError):
        calc(spark, text, 1.0, 1.0, order=Window.orderBy("a"))


def test_a_formula_that_fails_raises_when_read(spark):
    with pytest.raises(Exception, match="division by zero"):
        calc(spark, "a / b", 1.0, 0.0)
    assert calc(spark, "a / b", 1.0, 0.0, division="zero") == 0
    with pytest.raises(Exception, match="missing"):
        calc(spark, "a + b", 1.0, None, missing="error")


SEX = Conversion("sex", (Category(1, "M"), Category(2, "F"), Category(3, "")), (CodeRange(3, "0", "9"), CodeRange(1, "1", "1"), CodeRange(2, "2", "2")))


def cells(spark, rows, spec, schema="a string, b string, v string"):
    t = tabulate.tabulate(spark.createDataFrame(rows, schema), spec)
    return {(r.row_label, r.col_label): r.value for r in t.cells.collect()}


def test_last_rule_wins_axes_are_dense_and_an_empty_label_is_the_number(spark):
    got = cells(spark, [("1", "x", "2"), ("2", "x", "x"), ("1", "y", None)], TabulationSpec(Dimension("a", SEX), Dimension("b"), (Measure("sum", "v"),)))
    assert got == {("M", "x"): 2, ("M", "y"): 0, ("F", "x"): 0, ("F", "y"): 0, ("3", "x"): 0, ("3", "y"): 0}


def test_first_rule_wins_in_literal_tables(spark):
    literal = Conversion("sex", SEX.categories, SEX.rules, precedence="first")
    assert cells(spark, [("1", "x", "2")], TabulationSpec(Dimension("a", literal), suppress_rows=True)) == {("3", "Frequência"): 1}


def test_records_without_a_key_are_omitted_or_discriminated(spark):
    rows = [("1", "", "1"), ("7", None, "1"), ("x", "k", "1")]
    assert cells(spark, rows, TabulationSpec(Dimension("b"))) == {("k", "Frequência"): 1}
    got = cells(spark, rows, TabulationSpec(Dimension("b", unclassified="discriminate")))
    assert got == {("Não classificados", "Frequência"): 2, ("k", "Frequência"): 1}


def test_empty_table(spark):
    assert cells(spark, [], TabulationSpec(Dimension("a", SEX))) == {("M", "Frequência"): 0, ("F", "Frequência"): 0, ("3", "Frequência"): 0}
    assert cells(spark, [], TabulationSpec(Dimension("b"), Dimension("a"))) == {}


def test_wide_results_stay_long(spark):
    d = spark.range(6000).select(F.lit("BR").alias("r"), F.format_string("%06d", "id").alias("c"))
    t = tabulate.tabulate(d, TabulationSpec(Dimension("r"), Dimension("c")))
    assert t.cells.count() == 6000
    with pytest.raises(ValueError, match="long form"):
        t.to_wide()


def test_plans_are_checked_with_all_faults():
    spec = TabulationSpec(Dimension("nope"), Dimension("a"), (Measure(), Measure("sum", "zz")), (Filter("a", low=5, high=1),), (Rule("r", (Filter("a", low=1),)),))
    with pytest.raises(PlanError) as e:
        compile_plan(spec, ["a"])
    for part in ("nope", "several measures", "zz", "empty range", "two conditions"):
        assert part in str(e.value)


def test_subtotal_circles_are_found():
    loop = Conversion("loop", (Category(1, "a", 2), Category(2, "b", 1)), (CodeRange(1, "1", "1"),))
    with pytest.raises(PlanError, match="circle"):
        compile_plan(TabulationSpec(Dimension("a", loop)), ["a"])


def test_batches_add_up(spark):
    d = spark.range(500).select((F.col("id") % 4).cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"), (F.col("id") / 7).alias("v"))
    spec = TabulationSpec(Dimension("a"), Dimension("b"), (Measure("sum", "v"),), (Filter("v", low=3),))
    whole = {(r.row_key, r.col_key): r.value for r in tabulate.tabulate(d, spec).cells.collect()}
    parts = {}
    for k in range(3):
        for r in tabulate.tabulate(d.where(F.col("id") % 3 == k) if "id" in d.columns else d.where(F.pmod(F.floor(F.col("v") * 7 + 0.5), F.lit(3)) == k), spec).cells.collect():
            parts[r.row_key, r.col_key] = parts.get((r.row_key, r.col_key), 0) + r.value
    assert {k: round(v, 6) for k, v in whole.items()} == {k: round(v, 6) for k, v in parts.items()}


def test_join_keys(spark):
    left = spark.createDataFrame([(" 1 ", "a"), ("", "b"), (None, "c"), ("2", "d")], "k string, x string")
    right = spark.createDataFrame([(1, 10), (3, 30), (None, 40)], "k int, y int")
    full = transform.Join(right, [("k", "k")], "full").apply(left)
    assert sorted((r.k or "", r.x or "", r.y or 0) for r in full.collect()) == [("", "", 40), ("", "b", 0), ("", "c", 0), (" 1 ", "a", 10), ("2", "d", 0), ("3", "", 30)]


def test_many_to_many_is_refused(spark):
    left = spark.createDataFrame([("1", "a"), ("1", "b")], "k string, x string")
    right = spark.createDataFrame([("1", 1), ("1", 2)], "k string, y int")
    with pytest.raises(Exception, match="both sides"):
        transform.Join(right, [("k", "k")]).apply(left).collect()
    assert transform.Join(right, [("k", "k")], allow_many_to_many=True).apply(left).count() == 4


def test_steps_are_checked_before_anything_runs(spark):
    d = spark.createDataFrame([("1",)], "a string")
    with pytest.raises(PlanError):
        transform.run(d, [transform.Step("x", transform.SelectColumns(["nope"]), enabled=False)])
    with pytest.raises(PlanError):
        transform.run(d, [transform.Step("x", transform.SelectColumns(["a"])), transform.Step("x", transform.SelectColumns(["a"]))])


def test_cast_keep_and_summaries_without_numbers(spark):
    d = spark.createDataFrame([("1,5",), ("x",), (None,)], "a string")
    assert [r[0] for r in transform.Cast("a", "number", "keep").apply(d).collect()] == ["1.5", "x", None]
    assert transform.GroupSummarize([], [("sum", "a", "s"), ("distinct", "a", "n")]).apply(d.where("a = 'x'")).first().asDict() == {"s": None, "n": 1}


def test_registered_sql_is_neither_cut_nor_run_ahead(spark, monkeypatch):
    import quadro.queries_tables  # noqa: F401  (registers them)
    from quadro.queries import QUERIES

    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.count", lambda d: pytest.fail("counted"))
    for name in ("sql_passthrough", "sql_window", "sql_cube", "sql_set_ops", "sql_semi_join", "sql_percentile"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString()
        assert "Limit" not in plan
