"""Registered queries over the driver's tables, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadro.functions import coerce
from quadro.functions.formula import formula
from quadro.operators import tabulate as tab
from quadro.operators import transform as tr
from quadro.operators.predicates import rule_counts
from quadro.operators.tabulate import tabulate
from quadro.plans.spec import Category, CodeRange, Conversion, Dimension, Filter, Measure, Rule, TabulationSpec

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cells(df: DataFrame, spec: TabulationSpec, **lookups: DataFrame) -> DataFrame:
    c = tabulate(df, spec, lookups).cells
    return c.select("row_key", "row_label", "col_key", "col_label", F.round("value", 2).alias("value"))


# --- tabulation -----------------------------------------------------------------------


@query("""SELECT l_returnflag AS row_key, l_returnflag AS row_label, 'm0' AS col_key, 'Frequência' AS col_label, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2""")
def tab_count_1d(spark, sf):
    return _cells(table(spark, sf, "lineitem"), TabulationSpec(Dimension("l_returnflag")))


@query("""WITH f AS (SELECT * FROM lineitem WHERE l_quantity BETWEEN 10 AND 40), r AS (SELECT DISTINCT l_returnflag AS k FROM f), c AS (SELECT DISTINCT l_linestatus AS k FROM f)
SELECT r.k AS row_key, r.k AS row_label, c.k AS col_key, c.k AS col_label, CAST((SELECT count(*) FROM f WHERE l_returnflag = r.k AND l_linestatus = c.k) AS DOUBLE) AS value FROM r CROSS JOIN c""")
def tab_count_2d(spark, sf):
    return _cells(table(spark, sf, "lineitem"), TabulationSpec(Dimension("l_returnflag"), Dimension("l_linestatus"), filters=(Filter("l_quantity", low=10, high=40),)))


@query("""WITH a AS (SELECT o_orderpriority AS r, o_orderstatus AS c, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2), rr AS (SELECT DISTINCT r FROM a), cc AS (SELECT DISTINCT c FROM a)
SELECT rr.r AS row_key, rr.r AS row_label, cc.c AS col_key, cc.c AS col_label, round(coalesce(a.v, 0), 2) AS value FROM rr CROSS JOIN cc LEFT JOIN a ON a.r = rr.r AND a.c = cc.c""")
def tab_sum_2d(spark, sf):
    return _cells(table(spark, sf, "orders"), TabulationSpec(Dimension("o_orderpriority"), Dimension("o_orderstatus"), (Measure("sum", "o_totalprice"),)))


@query("""SELECT l_linestatus AS row_key, l_linestatus AS row_label, 'm0' AS col_key, 'Frequência' AS col_label, round(sum(l_quantity), 2) AS value FROM lineitem GROUP BY 1, 2""")
def tab_weighted(spark, sf):
    return _cells(table(spark, sf, "lineitem"), TabulationSpec(Dimension("l_linestatus"), measures=(Measure("weighted", "l_quantity"),)))


@query("""WITH a AS (SELECT l_returnflag AS k, CAST(count(*) AS DOUBLE) AS n, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 2) AS p FROM lineitem GROUP BY 1)
SELECT k AS row_key, k AS row_label, 'm0' AS col_key, 'Frequência' AS col_label, n AS value FROM a UNION ALL SELECT k, k, 'm1', 'Quantity', q FROM a UNION ALL SELECT k, k, 'm2', 'Valor', p FROM a""")
def tab_multi_measure(spark, sf):
    measures = (Measure(), Measure("sum", "l_quantity", "Quantity"), Measure("sum", "l_extendedprice"))
    return _cells(table(spark, sf, "lineitem"), TabulationSpec(Dimension("l_returnflag"), measures=measures))


@query("""WITH u AS (SELECT c_nationkey AS n, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier)
SELECT CAST(n AS VARCHAR) AS row_key, CAST(n AS VARCHAR) AS row_label, 'm0' AS col_key, 'Valor' AS col_label, round(sum(b), 2) AS value FROM u GROUP BY 1, 2""")
def tab_multi_source(spark, sf):
    from quadro.sources.append import append_sources

    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_acctbal").alias("b"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n"), F.col("s_acctbal").alias("b"))
    return _cells(append_sources({"customers": a, "suppliers": b}), TabulationSpec(Dimension("n"), measures=(Measure("sum", "b"),)))


SIZES = Conversion("sizes", (Category(1, "small"), Category(2, "medium"), Category(3, "large"), Category(4, "giant")), bands=((1, 10), (2, 30), (3, 50), (4, 1000)))


@query("""WITH a AS (SELECT CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 30 THEN 2 WHEN p_size <= 50 THEN 3 ELSE 4 END AS k FROM part), l AS (SELECT * FROM (VALUES (1, 'small'), (2, 'medium'), (3, 'large'), (4, 'giant')) t(k, label))
SELECT CAST(k AS VARCHAR) AS row_key, label AS row_label, 'm0' AS col_key, 'Frequência' AS col_label, CAST(count(*) AS DOUBLE) AS value FROM a JOIN l USING (k) GROUP BY 1, 2""")
def tab_suppress_rows(spark, sf):
    return _cells(table(spark, sf, "part"), TabulationSpec(Dimension("p_size", SIZES), suppress_rows=True))


@query("""WITH f AS (SELECT p_brand, CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 30 THEN 2 WHEN p_size <= 50 THEN 3 ELSE 4 END AS k FROM part WHERE p_size BETWEEN 11 AND 50), l AS (SELECT * FROM (VALUES (2, 'medium'), (3, 'large')) t(k, label)),
b AS (SELECT DISTINCT p_brand FROM f), c AS (SELECT DISTINCT l.k, label FROM l JOIN f USING (k))
SELECT p_brand AS row_key, p_brand AS row_label, CAST(c.k AS VARCHAR) AS col_key, c.label AS col_label, CAST((SELECT count(*) FROM f WHERE f.p_brand = b.p_brand AND f.k = c.k) AS DOUBLE) AS value FROM b CROSS JOIN c""")
def tab_suppress_cols(spark, sf):
    return _cells(table(spark, sf, "part"), TabulationSpec(Dimension("p_brand"), Dimension("p_size", SIZES), filters=(Filter("p_size", low=11, high=50),), suppress_columns=True))


@query("""SELECT count(*) AS seen, count(*) FILTER (WHERE l_returnflag IN ('A', 'R') AND l_quantity > 25) AS accepted, CAST(0 AS BIGINT) AS not_numbers_l_tax FROM lineitem""")
def tab_counters(spark, sf):
    spec = TabulationSpec(Dimension("l_linestatus"), measures=(Measure("sum", "l_tax"),), filters=(Filter("l_returnflag", categories=("A", "R")), Filter("l_quantity", low=25, low_open=True)))
    return tabulate(table(spark, sf, "lineitem"), spec, counted=True).counters()


@query("""WITH a AS (SELECT o_orderstatus AS c, o_orderpriority AS r, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)
SELECT c AS col_key, sum(v) AS sum, max(v) AS max, min(v) AS min, round(avg(v), 6) AS mean, arg_min(v, r) AS initial, arg_max(v, r) AS final FROM a GROUP BY 1""")
def tab_totals(spark, sf):
    cells = tabulate(table(spark, sf, "orders"), TabulationSpec(Dimension("o_orderpriority"), Dimension("o_orderstatus"))).cells
    out = None
    for how in ("sum", "max", "min", "mean", "initial", "final"):
        t = tab.totals(cells, how).withColumnRenamed("total", how)
        out = t if out is None else out.join(t, "col_key")
    return out.withColumn("mean", F.round("mean", 6))


@query("""WITH a AS (SELECT p_brand AS row_key, CAST(count(*) AS DOUBLE) AS weight FROM part GROUP BY 1)
SELECT row_key, row_key AS row_label, weight, round(weight / (SELECT sum(weight) FROM a), 9) AS share FROM a ORDER BY weight DESC, row_key LIMIT 3""")
def tab_headline(spark, sf):
    d = tab.headline(tabulate(table(spark, sf, "part"), TabulationSpec(Dimension("p_brand"))).cells)
    return d.withColumn("share", F.round("share", 9))


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.05""")
def tab_accepted_records(spark, sf):
    spec = TabulationSpec(Dimension("l_linestatus"), filters=(Filter("l_returnflag", categories=("R",)), Filter("l_discount", low=0.05)))
    return tab.accepted_records(table(spark, sf, "lineitem"), spec).select("l_orderkey", "l_linenumber")


# --- predicates -----------------------------------------------------------------------


def _labelled(spark, sf):
    """Documents with their labels: most quality values are null."""
    return table(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf, "labels"), "doc_id", "left")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt_categories(spark, sf):
    return tr.FilterRows([Filter("o_orderpriority", categories=("1-URGENT", "2-HIGH"))]).apply(table(spark, sf, "orders")).select("o_orderkey")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality <> 1")
def flt_exclude_null_kept(spark, sf):
    return tr.FilterRows([Filter("quality", "exclude", categories=("1",))]).apply(_labelled(spark, sf)).select("doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 7")
def flt_range_closed(spark, sf):
    return tr.FilterRows([Filter("l_quantity", low=5, high=7)]).apply(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (l_quantity > 5 AND l_quantity < 45)")
def flt_range_open(spark, sf):
    return tr.FilterRows([Filter("l_quantity", "exclude", low=5, high=45, low_open=True, high_open=True)]).apply(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) BETWEEN 0 AND 0.5")
def flt_null_is_zero(spark, sf):
    return tr.FilterRows([Filter("quality", low=0, high=0.5)]).apply(_labelled(spark, sf)).select("doc_id")


BIG_OPEN = Rule("big and open", (Filter("o_totalprice", low=200000), Filter("o_orderstatus", categories=("O",))))
URGENT_DONE = Rule("urgent and done", (Filter("o_orderpriority", categories=("1-URGENT",)), Filter("o_orderstatus", categories=("F",))), "exclude")


@query("""SELECT 'big and open' AS rule, 'flag' AS action, count(*) FILTER (WHERE o_totalprice >= 200000 AND o_orderstatus = 'O') AS records FROM orders
UNION ALL SELECT 'urgent and done', 'exclude', count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') FROM orders""")
def rule_flag_count(spark, sf):
    return rule_counts(table(spark, sf, "orders"), (BIG_OPEN, URGENT_DONE))


@query("""SELECT o_orderstatus AS row_key, o_orderstatus AS row_label, 'm0' AS col_key, 'Frequência' AS col_label, CAST(count(*) AS DOUBLE) AS value FROM orders
WHERE NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') GROUP BY 1, 2""")
def rule_exclude(spark, sf):
    return _cells(table(spark, sf, "orders"), TabulationSpec(Dimension("o_orderstatus"), rules=(BIG_OPEN, URGENT_DONE)))


# --- conversions ----------------------------------------------------------------------

ORDERS_LAST = Conversion("priority", (Category(1, "any"), Category(2, "urgent"), Category(3, "high")), (CodeRange(1, "1", "5"), CodeRange(2, "1", "1"), CodeRange(3, "2", "2")))
ORDERS_FIRST = Conversion("priority", ORDERS_LAST.categories, ORDERS_LAST.rules, precedence="first")


def _priorities(case: str) -> str:
    return f"""WITH k AS (SELECT {case} AS k FROM orders), l AS (SELECT * FROM (VALUES (1, 'any'), (2, 'urgent'), (3, 'high')) t(k, label))
SELECT CAST(l.k AS VARCHAR) AS row_key, label AS row_label, 'm0' AS col_key, 'Frequência' AS col_label, CAST(count(k.k) AS DOUBLE) AS value FROM l LEFT JOIN k ON k.k = l.k GROUP BY 1, 2"""


@query(_priorities("CASE substr(o_orderpriority, 1, 1) WHEN '2' THEN 3 WHEN '1' THEN 2 ELSE 1 END"))
def cnv_short_last_wins(spark, sf):
    return _cells(table(spark, sf, "orders"), TabulationSpec(Dimension("o_orderpriority", ORDERS_LAST)))


@query(_priorities("1"))
def cnv_literal_first_wins(spark, sf):
    return _cells(table(spark, sf, "orders"), TabulationSpec(Dimension("o_orderpriority", ORDERS_FIRST)))


@query("""WITH k AS (SELECT CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 30 THEN 2 WHEN p_size <= 50 THEN 3 ELSE 4 END AS k, p_retailprice AS v FROM part), l AS (SELECT * FROM (VALUES (1, 'small'), (2, 'medium'), (3, 'large'), (4, 'giant')) t(k, label))
SELECT CAST(l.k AS VARCHAR) AS row_key, label AS row_label, 'm0' AS col_key, 'Valor' AS col_label, round(coalesce(sum(v), 0), 2) AS value FROM l LEFT JOIN k ON k.k = l.k GROUP BY 1, 2""")
def cnv_numeric_bands(spark, sf):
    return _cells(table(spark, sf, "part"), TabulationSpec(Dimension("p_size", SIZES), measures=(Measure("sum", "p_retailprice"),)))


DIGITS = Conversion("second digit", (Category(1, "low"), Category(2, "high")), (CodeRange(1, "1", "2"), CodeRange(2, "3", "4")))


@query("""WITH k AS (SELECT CASE WHEN substr(p_brand, 8, 1) BETWEEN '1' AND '2' THEN 1 WHEN substr(p_brand, 8, 1) BETWEEN '3' AND '4' THEN 2 END AS k FROM part), l AS (SELECT * FROM (VALUES (1, 'low'), (2, 'high')) t(k, label))
SELECT CAST(l.k AS VARCHAR) AS row_key, label AS row_label, 'm0' AS col_key, 'Frequência' AS col_label, CAST(count(k.k) AS DOUBLE) AS value FROM l LEFT JOIN k ON k.k = l.k GROUP BY 1, 2""")
def cnv_start_position(spark, sf):
    return _cells(table(spark, sf, "part"), TabulationSpec(Dimension("p_brand", DIGITS, start=8)))


@query("""WITH k AS (SELECT CASE WHEN substr(p_brand, 8, 1) BETWEEN '1' AND '2' THEN '1' WHEN substr(p_brand, 8, 1) BETWEEN '3' AND '4' THEN '2' ELSE '__unclassified__' END AS k FROM part),
l AS (SELECT * FROM (VALUES ('1', 'low'), ('2', 'high'), ('__unclassified__', 'Não classificados')) t(k, label))
SELECT l.k AS row_key, label AS row_label, 'm0' AS col_key, 'Frequência' AS col_label, CAST(count(k.k) AS DOUBLE) AS value FROM l LEFT JOIN k ON k.k = l.k GROUP BY 1, 2""")
def cnv_unclassified(spark, sf):
    return _cells(table(spark, sf, "part"), TabulationSpec(Dimension("p_brand", DIGITS, start=8, unclassified="discriminate")))


TREE = Conversion(
    "tree", (Category(1, "all"), Category(2, "first", 1), Category(3, "rest", 1), Category(4, "second", 3), Category(5, "others", 3)),
    (CodeRange(2, "1", "1"), CodeRange(4, "2", "2"), CodeRange(5, "3", "5")))


@query("""WITH k AS (SELECT CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 2 WHEN '2' THEN 4 ELSE 5 END AS k FROM orders),
up AS (SELECT * FROM (VALUES (2, 2), (2, 1), (4, 4), (4, 3), (4, 1), (5, 5), (5, 3), (5, 1)) t(k, a)), l AS (SELECT * FROM (VALUES (1, 'all'), (2, 'first'), (3, 'rest'), (4, 'second'), (5, 'others')) t(a, label))
SELECT CAST(a AS VARCHAR) AS row_key, label AS row_label, 'm0' AS col_key, 'Frequência' AS col_label, CAST(count(*) AS DOUBLE) AS value FROM k JOIN up USING (k) JOIN l USING (a) GROUP BY 1, 2""")
def cnv_subtotals(spark, sf):
    return _cells(table(spark, sf, "orders"), TabulationSpec(Dimension("o_orderpriority", TREE)))


@query("""SELECT 'm0' AS col_key, CAST(count(*) AS DOUBLE) AS total FROM orders""")
def cnv_subtotals_total(spark, sf):
    cells = tabulate(table(spark, sf, "orders"), TabulationSpec(Dimension("o_orderpriority", TREE))).cells
    return tab.totals(cells, "sum", tab.excluded_from_total(TREE))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS row_key, n_nationkey || ' ' || n_name AS row_label, 'm0' AS col_key, 'Frequência' AS col_label, CAST(count(c_custkey) AS DOUBLE) AS value
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def lookup_dimension(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("label"))
    return _cells(table(spark, sf, "customer"), TabulationSpec(Dimension("c_nationkey", lookup="nations")), nations=nations)


# --- transformation -------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def pipe_select(spark, sf):
    return tr.SelectColumns([("o_orderkey", "id"), ("o_orderstatus", "status")]).apply(table(spark, sf, "orders"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < 50000 AND NOT (o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')")
def pipe_filter(spark, sf):
    return tr.FilterRows([Filter("o_totalprice", high=50000, high_open=True)], [URGENT_DONE]).apply(table(spark, sf, "orders")).select("o_orderkey")


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN 'fast' ELSE 'slow' END AS pace FROM orders")
def pipe_recode(spark, sf):
    return tr.Recode("o_orderpriority", {"1-URGENT": "fast", "2-HIGH": "fast"}, "pace", "=slow").apply(table(spark, sf, "orders")).select("o_orderkey", "pace")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def pipe_missing(spark, sf):
    return tr.MissingValues("o_orderpriority", ["4-NOT SPECIFIED", "5-LOW"]).apply(table(spark, sf, "orders")).select("o_orderkey", "o_orderpriority")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def pipe_dedupe_first(spark, sf):
    return tr.Dedupe(["o_custkey"], ["o_orderdate", "o_orderkey"]).apply(table(spark, sf, "orders")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def pipe_derive(spark, sf):
    d = table(spark, sf, "lineitem").drop("l_shipdate")
    d = tr.Derive("charge", "[l_extendedprice] * (1 - l_discount) * (1 + l_tax)").apply(d)
    return d.select("l_orderkey", "l_linenumber", F.round("charge", 6).alias("charge"))


@query("SELECT p_partkey, CASE WHEN regexp_full_match(substr(p_brand, 7), '[0-9]+') THEN CAST(substr(p_brand, 7) AS DOUBLE) END AS brand FROM part")
def pipe_cast_number(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", F.substring("p_brand", 7, 9).alias("brand"))
    return tr.Cast("brand", "number").apply(d)


@query("SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END AS price FROM part")
def pipe_cast_text(spark, sf):
    return tr.Cast("price", "text").apply(table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price")))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS VARCHAR) AS day FROM orders")
def pipe_cast_date(spark, sf):
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, "31/02/2020").when(k == 1, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    d = tr.Cast("day", "date").apply(table(spark, sf, "orders").select("o_orderkey", text.alias("day")))
    return d.withColumn("day", F.col("day").cast("string"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(quarter(o_orderdate) AS INTEGER) AS quarter FROM orders""")
def pipe_date_parts(spark, sf):
    d = table(spark, sf, "orders")
    for part in ("year", "month", "day", "quarter"):
        d = tr.DatePart("o_orderdate", part, part).apply(d)
    return d.select("o_orderkey", "year", "month", "day", "quarter")


@query("""WITH w AS (SELECT event_id, CAST(ts AS DATE) + CAST(3 - dayofweek(CAST(ts AS DATE)) AS INTEGER) AS w FROM events)
SELECT event_id, CAST(year(w) AS INTEGER) AS epi_year, CAST((dayofyear(w) - 1) // 7 + 1 AS INTEGER) AS epi_week FROM w""")
def pipe_epi_week(spark, sf):
    d = tr.DatePart("ts", "epi_week", "epi_week").apply(tr.DatePart("ts", "epi_year", "epi_year").apply(table(spark, sf, "events")))
    return d.select("event_id", "epi_year", "epi_week")


@query("""SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, lpad(CAST(c_nationkey AS VARCHAR), 3, '0') AS padded, substr(c_name, 3, 5) AS part,
CASE WHEN length(CAST(c_custkey AS VARCHAR)) <= 6 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE substr(CAST(c_custkey AS VARCHAR), 1, 6) END AS town FROM customer""")
def pipe_text(spark, sf):
    d = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("up"), F.col("c_mktsegment").alias("low"), F.col("c_nationkey").alias("padded"), F.col("c_name").alias("part"), F.col("c_custkey").alias("town"))
    for step in (tr.NormalizeText("up", "upper"), tr.NormalizeText("low", "lower"), tr.NormalizeText("padded", "pad_start", 3), tr.NormalizeText("part", "substring", 5, 3), tr.NormalizeText("town", "municipality")):
        d = step.apply(d)
    return d


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS mid, min(o_totalprice) AS low, max(o_totalprice) AS high,
count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1, 2""")
def pipe_group_summarize(spark, sf):
    measures = [("count", None, "n"), ("sum", "o_totalprice", "total"), ("mean", "o_totalprice", "mean"), ("median", "o_totalprice", "mid"), ("min", "o_totalprice", "low"), ("max", "o_totalprice", "high"), ("distinct", "o_custkey", "customers")]
    d = tr.GroupSummarize(["o_orderstatus", "o_orderpriority"], measures).apply(table(spark, sf, "orders"))
    return d.withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4), "mid": F.round("mid", 4)})


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment, NULL AS name, 'customers' AS origin FROM customer UNION ALL SELECT s_name, NULL, s_name, 'suppliers' FROM supplier""")
def pipe_bind_rows(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    b = table(spark, sf, "supplier").select(F.col("s_name").alias("key"), F.col("s_name").alias("name"))
    return tr.BindRows(b, "origin", ("customers", "suppliers")).apply(a).select("key", "segment", "name", "origin")


def _joined(spark, sf, how):
    """Customers with orders in 1995 and in 1996: neither year has all of them."""
    o = table(spark, sf, "orders")
    left = o.where("year(o_orderdate) = 1995").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    right = o.where("year(o_orderdate) = 1996").groupBy(F.col("o_custkey").cast("string").alias("who")).agg(F.count(F.lit(1)).cast("double").alias("orders"))
    d = tr.Join(right, [("o_custkey", "who")], how, "n_").apply(left)
    return d.select(F.col("o_custkey").cast("string").alias("o_custkey"), "top", "n_orders")


def _join_sql(how: str) -> str:
    return f"""WITH l AS (SELECT CAST(o_custkey AS VARCHAR) AS k, max(o_totalprice) AS top FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1),
r AS (SELECT CAST(o_custkey AS VARCHAR) AS k, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
SELECT coalesce(l.k, r.k) AS o_custkey, l.top, r.n AS n_orders FROM l {how} JOIN r ON l.k = r.k"""


@query(_join_sql("INNER"))
def pipe_join_inner(spark, sf):
    return _joined(spark, sf, "inner")


@query(_join_sql("LEFT"))
def pipe_join_left(spark, sf):
    return _joined(spark, sf, "left")


@query(_join_sql("RIGHT"))
def pipe_join_right(spark, sf):
    return _joined(spark, sf, "right")


@query(_join_sql("FULL"))
def pipe_join_full(spark, sf):
    return _joined(spark, sf, "full")


@query("""SELECT (SELECT count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)) AS matched, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS unmatched,
(SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS source_only, CAST(0 AS BIGINT) AS keyless""")
def pipe_join_counts(spark, sf):
    return tr.Join(table(spark, sf, "labels"), [("doc_id", "doc_id")]).counts(table(spark, sf, "documents").select("doc_id", "lang"))


@query("""WITH d AS (SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice / 1000 AS thousands FROM orders WHERE o_orderpriority NOT IN ('5-LOW'))
SELECT CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'other' END AS state, year, count(*) AS n, round(sum(thousands), 4) AS thousands FROM d GROUP BY 1, 2""")
def pipe_end_to_end(spark, sf):
    steps = [
        tr.Step("a", tr.FilterRows([Filter("o_orderpriority", "exclude", categories=("5-LOW",))])),
        tr.Step("b", tr.DatePart("o_orderdate", "year", "year")),
        tr.Step("c", tr.Derive("thousands", "o_totalprice / 1000")),
        tr.Step("d", tr.Recode("o_orderstatus", {"F": "done"}, "state", "=other")),
        tr.Step("off", tr.SelectColumns(["o_orderkey"]), enabled=False),
        tr.Step("e", tr.GroupSummarize(["state", "year"], [("count", None, "n"), ("sum", "thousands", "thousands")])),
    ]
    return tr.run(table(spark, sf, "orders"), steps).withColumn("thousands", F.round("thousands", 4))


@query("""SELECT 'keep' AS step, count(*) AS before, count(*) FILTER (WHERE o_orderstatus = 'F') AS after FROM orders
UNION ALL SELECT 'first', count(*) FILTER (WHERE o_orderstatus = 'F'), count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'F') FROM orders""")
def pipe_step_counts(spark, sf):
    steps = [tr.Step("keep", tr.FilterRows([Filter("o_orderstatus", categories=("F",))])), tr.Step("first", tr.Dedupe(["o_custkey"], ["o_orderkey"]))]
    return tr.step_counts(table(spark, sf, "orders"), steps)


# --- formulas -------------------------------------------------------------------------


def _formulas(df: DataFrame, keys: list[str], made: dict[str, str], digits: int = 6, **options) -> DataFrame:
    numeric = {c: F.col(c) for c, t in df.dtypes if t in ("bigint", "int", "double")}
    return df.select(*keys, *[F.round(formula(text, numeric, **options), digits).alias(name) for name, text in made.items()])


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity + l_tax + l_discount, 6) AS total, round((l_quantity + l_tax) / 2, 6) AS mean, least(l_quantity, l_linenumber) AS low, greatest(l_quantity, l_linenumber) AS high,
round(list_sort([l_quantity, l_tax, CAST(l_linenumber AS DOUBLE)])[2], 6) AS mid, CAST(3 AS DOUBLE) AS n FROM lineitem""")
def fx_aggregates(spark, sf):
    d = table(spark, sf, "lineitem")
    return _formulas(d, ["l_orderkey", "l_linenumber"], {"total": "SUM(l_quantity; l_tax; l_discount)", "mean": "MÉDIA(l_quantity, l_tax)", "low": "MIN(l_quantity, l_linenumber)", "high": "MAXIMO(l_quantity, l_linenumber)", "mid": "MEDIAN(l_quantity, l_tax, l_linenumber)", "n": "COUNT(l_quantity, l_tax, 5)"})


@query("""SELECT p_partkey, -power(p_size, 2) AS neg, round(sqrt(p_size), 6) AS root, round(exp(p_size / 10), 4) AS e, round(ln(p_size), 6) AS nat, round(log10(p_size), 6) AS ten, round(ln(p_size) / ln(2), 6) AS two,
CASE WHEN p_size > 20 THEN 1.0 ELSE 0.0 END + p_size % 1 AS big FROM part""")
def fx_arithmetic(spark, sf):
    made = {"neg": "-p_size^2", "root": "RAIZ(p_size)", "nat": "LN(p_size)", "ten": "LOG10(p_size)", "two": "LOG(p_size, 2)", "big": "(p_size > 20) + 0"}
    d = table(spark, sf, "part")
    a = _formulas(d, ["p_partkey"], made)
    return a.join(_formulas(d, ["p_partkey"], {"e": "EXP(p_size / 10)"}, 4), "p_partkey")


@query("""SELECT l_orderkey, l_linenumber, CAST(round(CAST(l_extendedprice AS DECIMAL(18, 4)), 1) AS DOUBLE) AS near, CAST(ceil(CAST(l_extendedprice AS DECIMAL(18, 4)) * 10) / 10 AS DOUBLE) AS up,
CAST(floor(CAST(l_extendedprice AS DECIMAL(18, 4)) * 10) / 10 AS DOUBLE) AS down, -floor(l_extendedprice / 100) AS cut, floor(-l_extendedprice) AS whole FROM lineitem""")
def fx_rounding(spark, sf):
    made = {"near": "ROUND(l_extendedprice, 1)", "up": "ROUNDUP(l_extendedprice, 1)", "down": "ROUNDDOWN(l_extendedprice, 1)", "cut": "TRUNCAR(-l_extendedprice / 100)", "whole": "INT(-l_extendedprice)"}
    return _formulas(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], made)


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 2.0 ELSE 1.0 END AS pick, CASE WHEN p_size < 10 THEN 1.0 WHEN p_size < 30 THEN 2.0 ELSE 3.0 END AS band, CASE WHEN p_size > 5 AND p_retailprice > 1000 THEN 1.0 ELSE 0.0 END AS both,
CASE WHEN p_size > 45 OR p_size < 3 THEN 1.0 ELSE 0.0 END AS either, CASE WHEN p_size = 7 THEN 0.0 ELSE 1.0 END AS other FROM part""")
def fx_logic(spark, sf):
    made = {"pick": "SE(p_size > 25; 2; 1)", "band": "IFS(p_size < 10, 1, p_size < 30, 2, 1, 3)", "both": "E(p_size > 5, p_retailprice > 1000)", "either": "OU(p_size > 45, p_size < 3)", "other": "NÃO(p_size = 7)"}
    return _formulas(table(spark, sf, "part"), ["p_partkey"], made)


@query("""SELECT p_partkey, round(CASE WHEN p_size % 7 = 0 THEN -1 ELSE 100.0 / (p_size % 7) END, 6) AS safe, CASE WHEN p_size - 9 > 0 THEN 1.0 ELSE 0.0 END AS number FROM part""")
def fx_iferror(spark, sf):
    d = table(spark, sf, "part").withColumn("rest", F.col("p_size") % 7)
    return _formulas(d, ["p_partkey"], {"safe": "IFERROR(100 / rest; -1)", "number": "ISNUMBER(LN(p_size - 9))"})


@query("""WITH a AS (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n, sum(o_totalprice) AS v, min(o_totalprice) AS low FROM orders GROUP BY 1)
SELECT o_custkey, round(n / v * 100000, 6) AS rate, round(low / v * 100, 6) AS percent, round(low / v, 6) AS ratio, round(v - low, 4) AS change, round((v - low) / low * 100, 4) AS pct FROM a""")
def fx_epidemiology(spark, sf):
    d = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("v"), F.min("o_totalprice").alias("low"))
    a = _formulas(d, ["o_custkey"], {"rate": "TAXA(n, v)", "percent": "PERCENT(low, v)", "ratio": "RAZÃO(low, v)"})
    return a.join(_formulas(d, ["o_custkey"], {"change": "CHANGE(v, low)", "pct": "PCTCHANGE(v, low)"}, 4), "o_custkey")


@query("""WITH m AS (SELECT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT month, CAST(n - lag(n) OVER (ORDER BY month) AS DOUBLE) AS step, CAST(coalesce(lag(n, 12) OVER (ORDER BY month), 0) AS DOUBLE) AS year_ago FROM m""")
def fx_lag(spark, sf):
    d = table(spark, sf, "orders").groupBy((F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    made = {"step": "n - LAG(n)", "year_ago": "IFERROR(LAG(n, 12), 0)"}
    d, before = tr.with_lags(d, list(made.values()), ["month", "n"], ["month"])
    return _formulas(d, ["month"], made, on_error="null", order=before)


@query("""WITH m AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT o_custkey, round((v - avg(v) OVER ()) / stddev_samp(v) OVER (), 6) AS z FROM m""")
def fx_zscore(spark, sf):
    d = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return _formulas(d, ["o_custkey"], {"z": "ZSCORE(v)"}, whole=d)
