"""Registered queries on result tables, statistics, profiles, flows and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadro.functions import coerce
from quadro.operators import places
from quadro.operators import profiling as prof
from quadro.operators import statistics as st
from quadro.operators import tableops as ops
from quadro.operators.ordered import numbered
from quadro.operators.predicates import matches
from quadro.operators.tabulate import tabulate
from quadro.plans.spec import Dimension, Measure, TabulationSpec
from quadro.queries import query, table
from quadro.sources.dbf import read_dbf, write_dbf_files
from quadro.sources.delimited import read_delimited
from quadro.sources.scratch import scratch_path
from quadro.sources.sinks import labelled_records, write_records
from quadro.sql import register
from quadro.streaming.tables import read_snapshot, read_updates, running_cells, running_combinations, running_flows, windowed_counts, write_snapshots, write_updates


def _nations(spark, sf) -> DataFrame:
    """A result table: customers and their balances by nation."""
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("v"))
    d = c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return d.select(F.col("n_nationkey").cast("string").alias("row_key"), F.col("n_name").alias("row_label"), F.col("n_nationkey").cast("int").alias("ord"), "n", "v")


T = "t AS (SELECT CAST(n_nationkey AS VARCHAR) AS row_key, n_name AS row_label, CAST(n_nationkey AS INTEGER) AS ord, CAST(count(*) AS DOUBLE) AS n, round(sum(c_acctbal), 2) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"


def _rounded(d: DataFrame, digits: int = 6) -> DataFrame:
    return d.withColumns({c: F.round(c, digits) for c, t in d.dtypes if t == "double"})


@query(f"WITH {T} SELECT row_key, n + v AS a, n - v AS b, round(n * v, 4) AS c, round(v / n, 4) AS d, least(n, v) AS e, greatest(n, v) AS f, round(n / v * 100, 4) AS g FROM t")
def op_binary(spark, sf):
    d = _nations(spark, sf)
    for name, kind in zip("abc", ("add", "subtract", "multiply"), strict=True):
        d = ops.binary(d, name, kind, "n", "v")
    d = ops.binary(ops.binary(ops.binary(d, "d", "divide", "v", "n"), "e", "minimum", "n", "v"), "f", "maximum", "n", "v")
    return _rounded(ops.binary(d, "g", "percentage", "n", "v").select("row_key", *"abcdefg"), 4)


@query(f"WITH {T} SELECT row_key, round(v * 2.5, 4) AS a, round(sum(v) OVER (ORDER BY ord ROWS UNBOUNDED PRECEDING), 2) AS b, abs(v) AS c, trunc(v / 1) AS d, floor(v + 0.5) AS e, floor(v) AS f, ceil(v) AS g FROM t")
def op_unary(spark, sf):
    d = _nations(spark, sf)
    for name, kind in zip("abcdefg", ("factor", "cumulative", "absolute", "truncate", "round", "floor", "ceil"), strict=True):
        d = ops.unary(d, name, kind, "v", 2.5)
    return d.select("row_key", F.round("a", 4).alias("a"), F.round("b", 2).alias("b"), *"cdefg")


@query(f"WITH {T} SELECT row_key, 10.0 + 5.0 * (row_number() OVER (ORDER BY ord) - 1) AS s, CAST(7 AS DOUBLE) AS k FROM t")
def op_sequence(spark, sf):
    return ops.constant(ops.sequence(_nations(spark, sf), "s", 10, 5), "k", 7).select("row_key", "s", "k")


@query(f"WITH {T} SELECT row_key, round(CASE WHEN n > 5 THEN v / n ELSE 0 END, 4) AS x, round((v - avg(v) OVER ()) / stddev_samp(v) OVER (), 4) AS z FROM t")
def op_expression(spark, sf):
    d = ops.expression(ops.expression(_nations(spark, sf), "x", "IF(n > 5; RATIO(v; n); 0)"), "z", "ZSCORE(v)")
    return _rounded(d.select("row_key", "x", "z"), 4)


@query(f"WITH {T} SELECT ord, v AS balance, row_key, row_label FROM t")
def op_columns(spark, sf):
    return ops.replay(_nations(spark, sf), [("rename", {"old": "v", "new": "balance"}), ("move", {"column": "balance", "place": 0}), ("delete", {"column": "n"})])


@query("""SELECT s AS row_key, p AS col_key, CAST(count(o_orderkey) AS DOUBLE) AS value FROM (SELECT DISTINCT o_orderstatus AS s FROM orders) CROSS JOIN (SELECT DISTINCT o_orderpriority AS p FROM orders)
LEFT JOIN orders ON o_orderstatus = s AND o_orderpriority = p GROUP BY 1, 2""")
def op_transpose(spark, sf):
    cells = tabulate(table(spark, sf, "orders"), TabulationSpec(Dimension("o_orderpriority"), Dimension("o_orderstatus"))).cells
    return ops.transpose(cells).select("row_key", "col_key", "value")


@query(f"WITH {T}, s AS (SELECT CAST(n_nationkey AS VARCHAR) AS k, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation) SELECT row_key, n, CAST(s AS DOUBLE) AS s_n FROM t JOIN s ON k = row_key")
def op_include(spark, sf):
    t = _nations(spark, sf)
    s = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_nationkey").cast("string").alias("row_key")).agg(F.count("s_suppkey").cast("double").alias("n"))
    return ops.include(t, s.join(t.select("row_key"), "row_key", "left_semi"), ["n"], "s_").select("row_key", "n", "s_n")


@query(f"WITH {T} SELECT row_key, n FROM t WHERE row_key NOT IN ('1', '2')")
def op_suppress(spark, sf):
    return ops.suppress_rows(_nations(spark, sf), ["1", "2"]).select("row_key", "n")


@query(f"WITH {T} SELECT row_key, row_label, n, v FROM t WHERE row_key NOT IN ('0', '5', '14') UNION ALL SELECT 'africa', 'Africa', sum(n), round(sum(v), 2) FROM t WHERE row_key IN ('0', '5', '14')")
def op_aggregate_rows(spark, sf):
    d = ops.aggregate_rows(_nations(spark, sf), ["0", "5", "14"], "africa", "Africa")
    return d.select("row_key", "row_label", "n", F.round("v", 2).alias("v"))


@query(f"WITH {T} SELECT row_label, n FROM t WHERE lower(row_label) LIKE '%nation_1%'")
def op_search(spark, sf):
    return ops.presented(_nations(spark, sf), "n", True, "Nátion_1").select("row_label", "n")


@query(f"WITH {T} SELECT row_label, n FROM t ORDER BY n DESC, row_label LIMIT 5")
def op_ranked(spark, sf):
    return ops.ranked(_nations(spark, sf), "n", 5).select("row_label", "n")


@query(f"WITH {T} SELECT row_key, row_label, n AS x, v AS y, n + v AS size FROM t")
def op_scatter(spark, sf):
    return ops.scatter(_nations(spark, sf), "n", "v")


@query(f"WITH {T} SELECT row_key, row_label, n AS start, v AS \"end\" FROM t ORDER BY abs(v - n) DESC, row_label LIMIT 7")
def op_arrows(spark, sf):
    return ops.arrows(_nations(spark, sf), 7)


@query(f"WITH {T} SELECT 'n' AS series, row_key, row_label, n AS value FROM t UNION ALL SELECT 'v', row_key, row_label, v FROM t")
def op_series(spark, sf):
    return ops.series(_nations(spark, sf))


@query("""SELECT TRUE AS row_labels, TRUE AS column_labels, TRUE AS shape, count(*) FILTER (WHERE n % 10 = 0) = 0 AS cells, count(*) FILTER (WHERE n % 10 = 0) AS differing, count(*) FILTER (WHERE n % 10 = 0) = 0 AS passed
FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority, year(o_orderdate))""")
def tab_golden(spark, sf):
    """A table against itself with tens made wrong by 2, at a tolerance of 1."""
    d = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate").cast("string"))
    cells = tabulate(d, TabulationSpec(Dimension("o_orderpriority"), Dimension("year"))).cells
    return ops.against_golden(cells, cells.withColumn("value", F.col("value") + F.when(F.col("value") % 10 == 0, 2).otherwise(1)), 1)


# --- comparison -------------------------------------------------------------------------


def _year(spark, sf, year: int) -> DataFrame:
    """Orders of a year by customer; no year has all customers."""
    d = table(spark, sf, "orders").where(f"year(o_orderdate) = {year}")
    return d.groupBy(F.col("o_custkey").cast("string").alias("row_key")).agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("row_label", F.concat(F.lit("Cliente nº "), F.col("row_key")))


def _compare_sql(how: str) -> str:
    side = lambda y: f"SELECT CAST(o_custkey AS VARCHAR) AS k, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE year(o_orderdate) = {y} GROUP BY 1"
    return f"""WITH a AS ({side(1995)}), b AS ({side(1996)}) SELECT coalesce(a.k, b.k) AS row_key, a.n AS "left", b.n AS "right", b.n - a.n AS difference,
round((b.n - a.n) / a.n * 100, 6) AS relative, round(b.n / a.n, 6) AS ratio FROM a {how} JOIN b ON a.k = b.k"""


def _compared(spark, sf, how: str, match: str = "key") -> DataFrame:
    d = ops.compare(_year(spark, sf, 1995), _year(spark, sf, 1996), "n", how=how, match=match)
    return d.select("row_key", "left", "right", "difference", F.round("relative", 6).alias("relative"), F.round("ratio", 6).alias("ratio"))


@query(_compare_sql("INNER"))
def cmp_key_inner(spark, sf):
    return _compared(spark, sf, "inner")


@query(_compare_sql("LEFT"))
def cmp_key_left(spark, sf):
    return _compared(spark, sf, "left")


@query(_compare_sql("RIGHT"))
def cmp_key_right(spark, sf):
    return _compared(spark, sf, "right")


@query(_compare_sql("FULL"))
def cmp_key_full(spark, sf):
    return _compared(spark, sf, "full")


@query(_compare_sql("INNER"))
def cmp_label(spark, sf):
    return _compared(spark, sf, "inner", "label")


@query("""WITH a AS (SELECT o_custkey AS k, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE year(o_orderdate) = 1995 GROUP BY 1),
b AS (SELECT o_custkey AS k, CAST(count(*) AS DOUBLE) AS n FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1)
SELECT CAST(a.k AS VARCHAR) AS row_key, a.n AS "left", b.n AS "right" FROM a JOIN b ON b.k = a.k + 1""")
def cmp_explicit(spark, sf):
    key = F.col("c_custkey")
    pairs = table(spark, sf, "customer").select(key.cast("string").alias("left_key"), (key + 1).cast("string").alias("right_key"))
    return ops.compare(_year(spark, sf, 1995), _year(spark, sf, 1996), "n", match="map", mapping=pairs).select("row_key", "left", "right")


@query(f"""WITH c AS ({_compare_sql('INNER')}) SELECT count(*) AS n, round(avg(abs(difference)), 6) AS mae, round(sqrt(avg(difference * difference)), 6) AS rmse, round(avg(abs(difference / "left")) * 100, 6) AS mape, round(corr("left", "right"), 6) AS pearson FROM c""")
def cmp_summary(spark, sf):
    return _rounded(ops.compare_summary(ops.compare(_year(spark, sf, 1995), _year(spark, sf, 1996), "n", how="full")))


@query("""WITH a AS (SELECT o_orderpriority AS r, CAST(year(o_orderdate) AS VARCHAR) AS c, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE year(o_orderdate) < 1997 GROUP BY 1, 2),
b AS (SELECT o_orderpriority AS r, CAST(year(o_orderdate) AS VARCHAR) AS c, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE year(o_orderdate) > 1993 AND o_orderstatus <> 'P' GROUP BY 1, 2)
SELECT coalesce(a.r, b.r) AS row_key, coalesce(a.c, b.c) AS col_key, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'changed' END AS status, a.v AS before, b.v AS after
FROM a FULL JOIN b ON a.r = b.r AND a.c = b.c""")
def tab_diff(spark, sf):
    d = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    spec = TabulationSpec(Dimension("o_orderpriority"), Dimension("year"))
    return ops.diff(tabulate(d.where("year < 1997"), spec).cells, tabulate(d.where("year > 1993 and o_orderstatus <> 'P'"), spec).cells)


# --- statistics -------------------------------------------------------------------------


@query("""SELECT count(*) AS count, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min, max(o_totalprice) AS max, round(median(o_totalprice), 4) AS median,
round(var_samp(o_totalprice), 0) AS variance, round(stddev_samp(o_totalprice), 3) AS sd FROM orders""")
def stat_descriptive(spark, sf):
    d = st.descriptive(table(spark, sf, "orders"), "o_totalprice")
    return d.select("count", F.round("sum", 2).alias("sum"), F.round("mean", 4).alias("mean"), "min", "max", F.round("median", 4).alias("median"), F.round("variance", 0).alias("variance"), F.round("sd", 3).alias("sd"))


@query("SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 9) AS pearson FROM lineitem")
def stat_pearson(spark, sf):
    return _rounded(st.pearson(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"), 9)


@query("SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 9) AS r2 FROM lineitem")
def stat_ols(spark, sf):
    d = st.regression(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return d.select("n", F.round("slope", 5).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 9).alias("r2"))


@query("""WITH s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), b AS (SELECT CAST(least(floor((l_quantity - lo) / ((hi - lo) / 7)), 6) AS INTEGER) AS bin, count(*) AS c FROM lineitem, s GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / 7, 6) AS low, round(lo + (i + 1) * (hi - lo) / 7, 6) AS high, coalesce(c, 0) AS count FROM s, range(7) r(i) LEFT JOIN b ON b.bin = i""")
def stat_histogram(spark, sf):
    return _rounded(st.histogram(table(spark, sf, "lineitem"), "l_quantity", 7))


@query("""WITH v AS (SELECT c_acctbal AS x FROM customer), s AS (SELECT min(x) AS lo, max(x) AS hi, count(*) AS n, avg(x) AS m, stddev_samp(x) AS sd FROM v)
SELECT CAST(i AS INTEGER) AS bin, round(exp(-pow((lo + (i + 0.5) * (hi - lo) / 5 - m) / sd, 2) / 2) / (sd * sqrt(2 * pi())) * (hi - lo) / 5 * n, 4) AS expected FROM s, range(5) r(i)""")
def stat_gaussian(spark, sf):
    return _rounded(st.gaussian_overlay(table(spark, sf, "customer"), "c_acctbal", 5).select("bin", "expected"), 4)


def _strata(spark, sf) -> DataFrame:
    """Events, population, a standard and reference rates by priority."""
    d = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") == "P").cast("double").alias("events"), F.count(F.lit(1)).cast("double").alias("pop"), F.count_if(F.col("o_totalprice") > 100000).cast("double").alias("std"))
    return d.withColumn("ref", F.lit(2000.0))


STRATA = "s AS (SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS e, CAST(count(*) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE o_totalprice > 100000) AS DOUBLE) AS w FROM orders GROUP BY 1)"
LOW = "CASE WHEN e = 0 THEN 0 ELSE e * pow(1 - 1 / (9 * e) - 1.959963984540054 / (3 * sqrt(e)), 3) END"
HIGH = "CASE WHEN e = 0 THEN 3.6888794541139363 ELSE (e + 1) * pow(1 - 1 / (9 * (e + 1)) + 1.959963984540054 / (3 * sqrt(e + 1)), 3) END"


@query(f"WITH {STRATA} SELECT o_orderpriority, round(e / p * 100000, 6) AS rate, round({LOW} / p * 100000, 6) AS low, round({HIGH} / p * 100000, 6) AS high FROM s")
def epi_crude(spark, sf):
    return _rounded(st.crude_rate(_strata(spark, sf), "o_orderpriority", "events", "pop"))


def _customers(spark, sf) -> DataFrame:
    """The same by customer: many have no events, no weight or no rate."""
    d = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").cast("double").alias("events"), F.count(F.lit(1)).cast("double").alias("pop"), F.count_if(F.col("o_totalprice") > 400000).cast("double").alias("std"))
    return d.withColumn("ref", F.col("std") * 1000.0)


CUSTOMERS = "s AS (SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS e, CAST(count(*) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE o_totalprice > 400000) AS DOUBLE) AS w FROM orders GROUP BY 1)"


@query(f"""WITH {CUSTOMERS}, u AS (SELECT * FROM s WHERE w > 0), a AS (SELECT sum(w * e / p) / sum(w) AS r, sqrt(sum(w * w * e / (p * p))) / sum(w) AS sd, count(*) AS used FROM u)
SELECT round(r * 100000, 6) AS rate, round(greatest(0, r - 1.959963984540054 * sd) * 100000, 6) AS low, round((r + 1.959963984540054 * sd) * 100000, 6) AS high, round(sd * 100000, 6) AS error,
(SELECT round(sum(e) / sum(p) * 100000, 6) FROM s) AS crude, used, (SELECT count(*) FROM s WHERE w = 0) AS skipped FROM a""")
def epi_dsr(spark, sf):
    return _rounded(st.direct_standardization(_customers(spark, sf), "events", "pop", "std", label="o_custkey"))


@query(f"""WITH {CUSTOMERS}, a AS (SELECT sum(e) AS e, sum(p * w * 0.01) AS x, count(*) FILTER (WHERE w > 0) AS used, count(*) FILTER (WHERE w = 0) AS skipped FROM s)
SELECT e AS observed, round(x, 6) AS expected, round(e / x, 6) AS smr, round({LOW} / x, 6) AS low, round({HIGH} / x, 6) AS high, used, skipped FROM a""")
def epi_smr(spark, sf):
    return _rounded(st.indirect_standardization(_customers(spark, sf), "events", "pop", "ref", label="o_custkey"))


@query(f"""WITH {CUSTOMERS}, r AS (SELECT o_custkey, e / p AS a, sqrt(e) / p AS sa, w / p AS b, sqrt(w) / p AS sb FROM s)
SELECT o_custkey, CASE WHEN b > 0 THEN round(a / b, 6) END AS ratio, CASE WHEN a > 0 AND b > 0 THEN round(a / b * exp(-1.959963984540054 * sqrt(pow(sa / a, 2) + pow(sb / b, 2))), 6) END AS low,
CASE WHEN a > 0 AND b > 0 THEN round(a / b * exp(1.959963984540054 * sqrt(pow(sa / a, 2) + pow(sb / b, 2))), 6) END AS high FROM r""")
def epi_rate_ratio(spark, sf):
    """Customers without events or without a comparison have no limits, or no ratio."""
    d = _customers(spark, sf)
    rate = lambda c: F.col(c) / F.col("pop")
    ratio, low, high = st.rate_ratio(rate("events"), F.sqrt("events") / F.col("pop"), rate("std"), F.sqrt("std") / F.col("pop"))
    return _rounded(d.select("o_custkey", ratio.alias("ratio"), low.alias("low"), high.alias("high")))


@query("""WITH c AS (SELECT lang, CAST(count(*) FILTER (WHERE quality = 1) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1), z AS (SELECT *, 1.959963984540054 * 1.959963984540054 AS z2, k / n AS p FROM c)
SELECT lang, CAST(k AS BIGINT) AS hits, CAST(n AS BIGINT) AS total, round(greatest(0, ((p + z2 / (2 * n)) - sqrt(z2) * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS low,
round(least(1, ((p + z2 / (2 * n)) + sqrt(z2) * sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)), 6) AS high FROM z""")
def stat_wilson(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return _rounded(prof.proportions(d, "lang", F.col("quality") == 1).select("lang", "hits", "total", "low", "high"))


TWO = """c AS (SELECT o_orderpriority AS k, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1), w AS (SELECT *, sum(a) OVER () - a AS b, sum(n) OVER () - n AS m FROM c),
z AS (SELECT *, a / n - b / m AS d, (a / n - b / m) / sqrt((a + b) / (n + m) * (1 - (a + b) / (n + m)) * (1 / n + 1 / m)) AS z FROM w),
e AS (SELECT *, abs(z) / sqrt(2.0) AS x FROM z), f AS (SELECT *, 1 / (1 + 0.3275911 * x) AS t FROM e),
p AS (SELECT *, 1 - (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x)) AS p FROM f)"""


def _two(spark, sf) -> DataFrame:
    c = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count(F.lit(1)).alias("n"))
    s = c.agg(F.sum("a").alias("sa"), F.sum("n").alias("sn"))
    d = c.join(F.broadcast(s)).select("k", "a", "n", (F.col("sa") - F.col("a")).alias("b"), (F.col("sn") - F.col("n")).alias("m"))
    return st.two_proportions(d, "a", "n", "b", "m")


@query(f"WITH {TWO} SELECT k, round(d, 6) AS difference, round(a / n / (b / m), 6) AS ratio, round(a * (m - b) / (b * (n - a)), 6) AS odds_ratio, round(z, 6) AS z, round(p, 6) AS p FROM p")
def stat_two_prop(spark, sf):
    return _rounded(_two(spark, sf).select("k", "difference", "ratio", "odds_ratio", "z", "p"))


@query(f"WITH {TWO}, r AS (SELECT k, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, k) AS raw FROM p) SELECT k, round(least(1, min(raw) OVER (ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r")
def stat_bh(spark, sf):
    return _rounded(st.false_discovery(_two(spark, sf), "p", "k").select("k", "q"))


# --- profiles and anomalies -------------------------------------------------------------


@query("""WITH q AS (SELECT count(*) AS total, count(value) AS numeric, count(*) - count(value) AS missing, CAST(0 AS BIGINT) AS invalid, count(DISTINCT value) AS "distinct", min(value) AS min, max(value) AS max,
quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT total, numeric, missing, invalid, "distinct", round(min, 6) AS min, round(max, 6) AS max, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS low_fence, round(q3 + 1.5 * (q3 - q1), 6) AS high_fence,
(SELECT count(*) FROM events WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS outliers FROM q""")
def prof_numeric(spark, sf):
    return _rounded(prof.numeric_profile(table(spark, sf, "events"), "value"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS records, round(count(*) / (SELECT count(*) FROM lineitem), 9) AS share FROM lineitem GROUP BY 1, 2""")
def prof_combinations(spark, sf):
    return _rounded(prof.combinations(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]), 9)


@query("SELECT DISTINCT CAST(p_size AS VARCHAR) AS value FROM part WHERE p_size IS NOT NULL")
def prof_distinct(spark, sf):
    return prof.distinct_values(table(spark, sf, "part"), "p_size")[0]


def _outlier_sql(of: str, keys: str, value: str, threshold: float) -> str:
    return f"""WITH q AS (SELECT median({value}) AS m, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.75) AS q3 FROM {of}), d AS (SELECT median(abs({value} - m)) AS mad FROM {of}, q),
s AS (SELECT {keys}, {value} AS v, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q3 - q1 AS iqr, CASE WHEN mad > 0 THEN 0.67448975 * ({value} - m) / mad WHEN q3 > q1 THEN 1.349 * ({value} - m) / (q3 - q1) ELSE 0 END AS z FROM {of}, q, d WHERE {value} IS NOT NULL)
SELECT {keys}, round(z, 6) AS z, v < lo OR v > hi AS outside, floor(100 * least(1, greatest(abs(z) / {threshold} / 2, greatest(lo - v, v - hi, 0) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END / 3)) + 0.5) AS score
FROM s WHERE abs(z) >= {threshold} OR v < lo OR v > hi"""


@query(_outlier_sql("lineitem", "l_orderkey, l_linenumber", "l_extendedprice", 1.1))
def anom_numeric(spark, sf):
    return _rounded(prof.numeric_outliers(table(spark, sf, "lineitem"), "l_extendedprice", ["l_orderkey", "l_linenumber"], 1.1).drop("value"))


@query(_outlier_sql("events", "event_id", "value", 6.0))
def anom_fences(spark, sf):
    """Values within the limit of z that lie outside the fences."""
    return _rounded(prof.numeric_outliers(table(spark, sf, "events"), "value", ["event_id"], 6.0).drop("value"))


@query(_outlier_sql("nations", "c_nationkey", "share", 3.5).replace("WITH q AS", "WITH nations AS (SELECT c_nationkey, CASE WHEN count(*) FILTER (WHERE c_acctbal < -900) > 2 THEN 3.0 WHEN count(*) FILTER (WHERE c_acctbal < -900) = 0 THEN 1.0 ELSE 0.0 END AS share FROM customer GROUP BY 1), q AS"))
def anom_flat(spark, sf):
    """Values that are mostly the same: no MAD, perhaps no interquartile range."""
    low = F.count_if(F.col("c_acctbal") < -900)
    d = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.when(low > 2, 3.0).when(low == 0, 1.0).otherwise(0.0).alias("share"))
    return _rounded(prof.numeric_outliers(d, "share", ["c_nationkey"]).drop("value"))


@query("""WITH s AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, CAST(CASE WHEN count(*) % 3 = 0 THEN -count(*) ELSE least(count(*), 2) END AS DOUBLE) AS value FROM events GROUP BY 1, 2),
l AS (SELECT *, CASE WHEN value >= 0 THEN ln(1 + value) ELSE value END AS l FROM s), w AS (SELECT *, list(l) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM l),
c AS (SELECT *, list_median(near) AS center FROM w), m AS (SELECT *, list_median(list_transform(near, lambda x: abs(x - center))) AS mad, (list_aggregate(near, 'quantile_cont', 0.75) - list_aggregate(near, 'quantile_cont', 0.25)) / 1.349 AS spread FROM c),
z AS (SELECT *, CASE WHEN len(near) >= 3 THEN CASE WHEN mad > 0 THEN 0.67448975 * (l - center) / mad WHEN spread > 0 THEN (l - center) / spread ELSE 0 END END AS z FROM m)
SELECT day, event_type, value, round(exp(center) - 1, 6) AS center, round(z, 6) AS z, coalesce(abs(z) >= 3.5, false) AS outlier FROM z""")
def anom_temporal(spark, sf):
    """Small counts, some of them negative, so that flat neighbourhoods occur."""
    n = F.count(F.lit(1))
    s = table(spark, sf, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day"), "event_type").agg(F.when(n % 3 == 0, -n).otherwise(F.least(n, F.lit(2))).alias("value"))
    return _rounded(prof.temporal_outliers(s, "day", "value", ["event_type"]).select("day", "event_type", "value", "center", "z", "outlier"))


@query("""WITH a AS (SELECT l_returnflag AS k, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_quantity < 25 GROUP BY 1), b AS (SELECT l_returnflag AS k, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_quantity >= 25 GROUP BY 1),
d AS (SELECT coalesce(a.n, 0) / (SELECT sum(n) FROM a) AS p, coalesce(b.n, 0) / (SELECT sum(n) FROM b) AS q FROM a FULL JOIN b ON a.k = b.k),
s AS (SELECT sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js, sum(abs(p - q)) / 2 AS tv, max(abs(p - q)) AS largest FROM d),
c AS (SELECT *, floor(100 * least(1, 0.45 * js / 0.25 + 0.35 * tv / 0.35 + 0.20 * largest / 0.25) + 0.5) AS score FROM s)
SELECT round(js, 6) AS js, round(tv, 6) AS tv, round(largest, 6) AS largest, score, CASE WHEN score >= 75 THEN 'strong' WHEN score >= 40 THEN 'review' ELSE 'info' END AS severity FROM c""")
def anom_distribution(spark, sf):
    d = table(spark, sf, "lineitem")
    s = prof.distribution_shift(d.where("l_quantity < 25"), d.where("l_quantity >= 25"), "l_returnflag")
    return s.select(*[F.round(c, 6).alias(c) for c in ("js", "tv", "largest")], "score", "severity")


@query("""WITH a AS (SELECT l_quantity < 10 AS k, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_quantity < 20 GROUP BY 1), b AS (SELECT l_quantity < 10 AS k, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_quantity >= 5 GROUP BY 1),
d AS (SELECT coalesce(a.n, 0) / (SELECT sum(n) FROM a) AS p, coalesce(b.n, 0) / (SELECT sum(n) FROM b) AS q FROM a FULL JOIN b ON a.k = b.k),
s AS (SELECT sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS js, sum(abs(p - q)) / 2 AS tv, max(abs(p - q)) AS largest FROM d)
SELECT round(largest, 6) AS largest, floor(100 * least(1, 0.45 * js / 0.25 + 0.35 * tv / 0.35 + 0.20 * largest / 0.25) + 0.5) AS score FROM s""")
def anom_shift_of_one_share(spark, sf):
    """One share moves far, the whole little: the terms are limited together, not each."""
    d = table(spark, sf, "lineitem").withColumn("small", (F.col("l_quantity") < 10).cast("string"))
    return prof.distribution_shift(d.where("l_quantity < 20"), d.where("l_quantity >= 5"), "small").select(F.round("largest", 6).alias("largest"), "score")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents WHERE source <> '' GROUP BY 1), p AS (SELECT n / (SELECT sum(n) FROM c) AS p FROM c)
SELECT count(*) AS "values", round(max(p), 9) AS top_share, round(sum(p * p), 9) AS hhi, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 9) AS entropy FROM p""")
def anom_concentration(spark, sf):
    return _rounded(prof.concentration(table(spark, sf, "documents"), "source").drop("top_key"), 9)


@query("""WITH d AS (SELECT *, o_orderstatus = 'P' AS g FROM (SELECT o_orderstatus, CAST(year(o_orderdate) AS VARCHAR) AS year, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS priority FROM orders)),
n AS (SELECT CAST(count(*) FILTER (WHERE g) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE NOT g) AS DOUBLE) AS m FROM d),
c AS (SELECT 'o_orderstatus' AS field, o_orderstatus AS key, g FROM d UNION ALL SELECT 'year', year, g FROM d UNION ALL SELECT 'priority', priority, g FROM d),
k AS (SELECT field, key, CAST(count(*) FILTER (WHERE g) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE NOT g) AS DOUBLE) AS b FROM c GROUP BY 1, 2)
SELECT field, CASE WHEN key = '' THEN 'missing' ELSE 'category' END AS kind, key, round(a / n, 6) AS group_share, round(b / m, 6) AS reference_share,
CASE WHEN a / n - b / m >= 0.25 THEN 'strong' ELSE 'review' END AS severity, 'none' AS action FROM k, n WHERE a / n - b / m >= 0.1""")
def anom_audit(spark, sf):
    d = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate").cast("string"))
    d = d.withColumn("priority", F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0), "").otherwise(F.col("o_orderpriority")))
    s = prof.audit(d, F.col("o_orderstatus") == "P", ["o_orderstatus", "year", "priority"])
    return _rounded(s.select("field", "kind", "key", "group_share", "reference_share", "severity", "action"))


# --- flows and places -------------------------------------------------------------------


def _trade(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_linenumber").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))  # noqa: E741
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("s_nationkey", "c_nationkey", "l_quantity", "l_linenumber")


def _known(spark, sf) -> DataFrame:
    """The codes of known places: all nations but one."""
    return table(spark, sf, "nation").where("n_nationkey <> 3").select("n_nationkey")


TRADE = "e AS (SELECT CAST(s_nationkey AS VARCHAR) AS origin, CAST(c_nationkey AS VARCHAR) AS destination, sum(l_quantity) AS value, count(*) AS records FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"


@query(f"WITH {TRADE} SELECT origin, destination, round(value, 2) AS value, records FROM e WHERE origin <> '3' AND destination <> '3'")
def flow_od(spark, sf):
    return _rounded(prof.flows(_trade(spark, sf), "s_nationkey", "c_nationkey", "l_quantity", _known(spark, sf)), 2)


@query("""WITH t AS (SELECT CASE WHEN s_nationkey <> 7 THEN s_nationkey END AS o, CASE WHEN c_nationkey <> 8 THEN c_nationkey END AS d, l_linenumber = 2 AS bad FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)
SELECT count(*) AS records, count(*) FILTER (WHERE o <> 3 AND d <> 3 AND NOT bad) AS accepted, count(*) FILTER (WHERE o IS NULL) AS missing_origin, count(*) FILTER (WHERE d IS NULL) AS missing_destination,
count(*) FILTER (WHERE o = 3 AND d IS NOT NULL) AS unknown_origin, count(*) FILTER (WHERE d = 3 AND o IS NOT NULL) AS unknown_destination, count(*) FILTER (WHERE o <> 3 AND d <> 3 AND bad) AS invalid_weight FROM t""")
def flow_counters(spark, sf):
    """Origins of nation 7 and destinations of nation 8 are blank, second lines have a weight that is no number."""
    d = _trade(spark, sf).select(F.expr("nullif(s_nationkey, 7)").alias("o"), F.expr("nullif(c_nationkey, 8)").alias("d"), F.when(F.col("l_linenumber") == 2, "?").otherwise(F.col("l_quantity").cast("string")).alias("w"))
    return prof.flow_counters(d, "o", "d", "w", _known(spark, sf))


@query(f"WITH {TRADE} SELECT origin, destination, round(value, 2) AS value, records, row_number() OVER (ORDER BY round(value, 2) DESC, lpad(origin, 20, '0'), lpad(destination, 20, '0')) AS place FROM e")
def flow_order(spark, sf):
    """The order itself, as numbers of the rows."""
    edges = prof.flows(_trade(spark, sf), "s_nationkey", "c_nationkey", "l_quantity").withColumn("value", F.round("value", 2))
    return numbered(edges, prof.flow_order(), "place").withColumn("place", F.col("place") + 1)


@query(f"""WITH {TRADE}, p AS (SELECT CAST(n_nationkey AS VARCHAR) AS key, n_nationkey * 7.0 - 90 AS x, n_nationkey * 3.0 - 40 AS y FROM nation WHERE n_nationkey <> 5)
SELECT origin, destination, round(2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians(b.y - a.y) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * pow(sin(radians(b.x - a.x) / 2), 2)))), 4) AS distance
FROM e LEFT JOIN p a ON a.key = origin LEFT JOIN p b ON b.key = destination""")
def flow_distance(spark, sf):
    points = table(spark, sf, "nation").where("n_nationkey <> 5").select(F.col("n_nationkey").cast("string").alias("key"), (F.col("n_nationkey") * 7.0 - 90).alias("x"), (F.col("n_nationkey") * 3.0 - 40).alias("y"))
    d = prof.flow_distances(prof.flows(_trade(spark, sf), "s_nationkey", "c_nationkey"), points)
    return _rounded(d.select("origin", "destination", "distance"), 4)


@query("""WITH m AS (SELECT c_custkey, lpad(CAST(110000 + c_custkey * 3701 % 430000 AS VARCHAR), 6, '0') AS code FROM customer) SELECT CASE WHEN substr(code, 1, 2) BETWEEN '11' AND '53' THEN substr(code, 1, 2) END AS state, count(*) AS n FROM m GROUP BY 1""")
def geo_uf(spark, sf):
    code = F.lpad((110000 + F.col("c_custkey") * 3701 % 430000).cast("string"), 6, "0")
    return table(spark, sf, "customer").groupBy(coerce.state_of(code).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT i, round(list_extract((SELECT quantile_cont(c_acctbal, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) FROM customer), CAST(i + 1 AS INTEGER)), 4) AS upper FROM range(6) r(i)")
def map_quantile_classes(spark, sf):
    return _limits(spark, sf, "quantile", 5)


@query("WITH s AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT i, round(lo + (hi - lo) * i / 4, 4) AS upper FROM s, range(5) r(i)")
def map_equal_classes(spark, sf):
    return _limits(spark, sf, "equal", 4)


def _limits(spark, sf, kind: str, classes: int) -> DataFrame:
    limits = places.class_limits(table(spark, sf, "customer"), "c_acctbal", kind, classes)
    return spark.createDataFrame(list(enumerate(limits)), "i bigint, upper double").withColumn("upper", F.round("upper", 4))


def _classed(spark, sf, kind: str, breaks=()) -> DataFrame:
    d = table(spark, sf, "customer")
    limits = places.class_limits(d, "c_acctbal", kind, 5, breaks)
    return d.select("c_custkey", places.class_of(F.col("c_acctbal"), limits).cast("int").alias("class"), F.round(places.shade_of(F.col("c_acctbal"), limits), 9).alias("shade"))


SHADE = "round(sqrt((c_acctbal - lo) / (hi - lo)), 9) AS shade FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)"


@query(f"SELECT c_custkey, CAST(CASE WHEN c_acctbal <= 0 THEN 0 WHEN c_acctbal <= 1000 THEN 1 WHEN c_acctbal <= 7500.5 THEN 2 ELSE 3 END AS INTEGER) AS class, {SHADE}")
def map_manual_classes(spark, sf):
    return _classed(spark, sf, "manual", (0, 1000, 7500.5))


@query(f"SELECT c_custkey, CAST(CASE WHEN c_acctbal <= lo + (hi - lo) / 5 THEN 0 WHEN c_acctbal <= lo + (hi - lo) * 2 / 5 THEN 1 WHEN c_acctbal <= lo + (hi - lo) * 3 / 5 THEN 2 WHEN c_acctbal <= lo + (hi - lo) * 4 / 5 THEN 3 ELSE 4 END AS INTEGER) AS class, {SHADE}")
def map_continuous(spark, sf):
    return _classed(spark, sf, "continuous")


CODED = "m AS (SELECT *, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE CAST(90000 + (c_custkey % 97) * 5003 AS VARCHAR) END AS code FROM customer), s AS (SELECT CAST(n_nationkey + 11 AS VARCHAR) AS state, n_name AS nation FROM nation WHERE n_nationkey < 20)"


def _coded(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers with a municipality's code, the names of most codes, and those of some states."""
    key = F.col("c_custkey")
    d = table(spark, sf, "customer").withColumn("code", F.when(key % 50 != 0, (90000 + (key % 97) * 5003).cast("string")))
    names = d.groupBy("code").agg(F.when(F.first(key % 97 % 7) != 3, F.concat(F.lit("Município "), "code")).alias("name"))
    states = table(spark, sf, "nation").where("n_nationkey < 20").select((F.col("n_nationkey") + 11).cast("string").alias("code"), F.col("n_name").alias("name"), F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("sign"))
    return d, names, states


@query(f"""WITH {CODED}, k AS (SELECT code, count(*) AS records, coalesce(any_value(c_custkey % 97 % 7) <> 3 AND length(code) = 6 AND substr(code, 1, 2) BETWEEN '11' AND '53', FALSE) AS known FROM m GROUP BY 1),
t AS (SELECT CASE WHEN known THEN substr(code, 1, 2) END AS state, * FROM k), r AS (SELECT state, CAST(sum(records) AS BIGINT) AS state_records FROM t WHERE known GROUP BY 1)
SELECT t.state, coalesce(nation, 'UF ' || t.state) AS state_name, coalesce('S' || (CAST(s.state AS INTEGER) - 11), t.state) AS sign, code, CASE WHEN known THEN 'Município ' || code END AS place, records, state_records, known
FROM t LEFT JOIN r ON r.state = t.state LEFT JOIN s ON s.state = t.state""")
def geo_tree(spark, sf):
    d, names, states = _coded(spark, sf)
    return places.place_tree(d, "code", names, states)


@query(f"WITH {CODED} SELECT c_custkey, code FROM m WHERE c_custkey % 97 % 7 <> 3 AND length(code) = 6 AND substr(code, 1, 2) IN ('12', '31') OR code = '90000'")
def geo_selection(spark, sf):
    """Two states and one municipality, chosen as a map's user chooses them."""
    d, names, states = _coded(spark, sf)
    codes = places.codes_of(places.place_tree(d, "code", names, states), ["12", "31"], ["90000"])
    return d.where(matches(d, places.selection_filter("code", codes))).select("c_custkey", "code")


@query(f"WITH {T} SELECT CAST(n_nationkey AS VARCHAR) AS geocode, CAST(CASE WHEN n_nationkey < 20 THEN n_nationkey ELSE NULL END AS VARCHAR) AS code, coalesce(a.v, b.v) AS value FROM nation LEFT JOIN t a ON a.row_key = CASE WHEN n_nationkey < 20 THEN n_nationkey END::VARCHAR LEFT JOIN t b ON b.row_label = n_name WHERE n_regionkey IS NOT NULL")
def map_values(spark, sf):
    """Objects without a code of the result's find their value by name, in other letters."""
    n = table(spark, sf, "nation")
    code = F.col("n_nationkey").cast("string")
    objects = n.select(code.alias("id"), F.when(F.col("n_nationkey") < 20, code).otherwise("?").alias("geocode"), F.concat(F.lit(" "), F.lower("n_name")).alias("name"))
    d = places.on_map(objects, _nations(spark, sf).withColumnRenamed("v", "value"))
    return d.select(F.col("id").alias("geocode"), F.nullif(F.col("geocode"), F.lit("?")).alias("code"), "value")


def _box(low: float, high: float, bottom: float, top: float):
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((low, bottom), (high, bottom), (high, top), (low, top))])


@query("SELECT c_custkey, (c_acctbal BETWEEN 0.005 AND 5000.005 AND c_nationkey > 0 AND c_nationkey <= 12) AS inside FROM customer")
def map_point_in_polygon(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", prof.inside(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), _box(0.005, 5000.005, 0.5, 12.5)).alias("inside"))


@query("SELECT c_custkey, (c_acctbal BETWEEN 0.005 AND 5000.005 AND c_nationkey > 0 AND c_nationkey <= 12 AND NOT (c_acctbal BETWEEN 1000.005 AND 2000.005 AND c_nationkey BETWEEN 3 AND 6)) OR (c_acctbal BETWEEN 6000.005 AND 9000.005 AND c_nationkey BETWEEN 15 AND 20) AS inside FROM customer")
def map_point_in_parts(spark, sf):
    """An object of two islands, one with a hole."""
    parts = F.array(_box(0.005, 5000.005, 0.5, 12.5), _box(1000.005, 2000.005, 2.5, 6.5), _box(6000.005, 9000.005, 14.5, 20.5))
    return table(spark, sf, "customer").select("c_custkey", prof.inside_parts(F.col("c_acctbal"), F.col("c_nationkey").cast("double"), parts).alias("inside"))


# --- SQL --------------------------------------------------------------------------------


def _sql(spark, sf, text: str, *names: str) -> DataFrame:
    for n in names:
        register(table(spark, sf, n), n)
    return spark.sql(text)


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus")
def sql_passthrough(spark, sf):
    return _sql(spark, sf, "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM t_orders GROUP BY o_orderstatus", "orders")


@query("SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders")
def sql_window(spark, sf):
    return _sql(spark, sf, "SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM t_orders", "orders")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def sql_cube(spark, sf):
    return _sql(spark, sf, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM t_orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def sql_set_ops(spark, sf):
    return _sql(spark, sf, "SELECT c_nationkey AS k FROM t_customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM t_supplier EXCEPT SELECT n_nationkey FROM t_nation WHERE n_regionkey = 0", "customer", "supplier", "nation")


@query("SELECT l_orderkey FROM lineitem SEMI JOIN orders ON l_orderkey = o_orderkey AND o_totalprice > 300000 GROUP BY 1")
def sql_semi_join(spark, sf):
    return _sql(spark, sf, "SELECT DISTINCT l_orderkey FROM t_lineitem LEFT SEMI JOIN t_orders ON l_orderkey = o_orderkey AND o_totalprice > 300000", "lineitem", "orders")


@query("SELECT median(o_totalprice) AS mid, round(stddev_samp(o_totalprice), 3) AS sd FROM orders")
def sql_percentile(spark, sf):
    return _sql(spark, sf, "SELECT percentile(o_totalprice, 0.5) AS mid, round(stddev_samp(o_totalprice), 3) AS sd FROM t_orders", "orders")


# --- files and streams ------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, c_acctbal, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS code FROM customer")
def src_delimited(spark, sf):
    """Written with semicolons, read back and typed: codes with leading zeros stay texts."""
    path = scratch_path(spark, "delimited")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("code")).write.csv(path, sep=";", header=True)
    return read_delimited(spark, path)


@query("SELECT CAST(o_orderkey AS DOUBLE) AS id, o_orderpriority AS priority, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def src_dbf(spark, sf):
    """A table as DBF files, written by tasks and decoded by others."""
    path = scratch_path(spark, "dbf")
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").alias("day"))
    write_dbf_files(d, path, {"priority": 20}, {"price": 2}, most=50_000)
    return read_dbf(spark, path).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT p_partkey, p_size, CASE WHEN p_size <= 10 THEN 'small' WHEN p_size <= 30 THEN 'medium' WHEN p_size <= 50 THEN 'large' ELSE 'giant' END AS p_size_label FROM part")
def sink_labelled(spark, sf):
    from quadro.queries import SIZES

    d = labelled_records(table(spark, sf, "part").select("p_partkey", "p_size"), {"p_size": SIZES})
    path = scratch_path(spark, "labelled")
    write_records(d, path)
    back = spark.read.csv(path, sep=";", header=True)
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), F.col("p_size").cast("int").alias("p_size"), "p_size_label")


@query("SELECT event_type AS row_key, '0' AS col_key, CAST(count(*) AS DOUBLE) AS m0, round(sum(value), 4) AS m1 FROM events GROUP BY 1")
def stream_tabulation(spark, sf):
    """The table of a stream over the events, in as many batches as there are files."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).parquet(f"{sf}/events.parquet*")
    cells = running_cells(stream, TabulationSpec(Dimension("event_type"), measures=(Measure(), Measure("sum", "value"))))
    path = scratch_path(spark, "snapshot")
    write_snapshots(cells, path, scratch_path(spark, "stream")).awaitTermination()
    return read_snapshot(spark, path).withColumn("m1", F.round("m1", 4))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    path = scratch_path(spark, "windows")
    write_updates(windowed_counts(stream, "ts", "event_type"), path, scratch_path(spark, "stream")).awaitTermination()
    return read_updates(spark, path, ["start", "event_type"])


@query("SELECT l_returnflag AS origin, l_linestatus AS destination, sum(l_quantity) AS value, count(*) AS records FROM lineitem GROUP BY 1, 2")
def stream_flows(spark, sf):
    stream = spark.readStream.schema(table(spark, sf, "lineitem").schema).parquet(f"{sf}/lineitem.parquet*")
    path = scratch_path(spark, "flows")
    write_snapshots(running_flows(stream, "l_returnflag", "l_linestatus", "l_quantity"), path, scratch_path(spark, "stream")).awaitTermination()
    return read_snapshot(spark, path)


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS records FROM orders GROUP BY 1, 2")
def stream_combinations(spark, sf):
    stream = spark.readStream.schema(table(spark, sf, "orders").schema).parquet(f"{sf}/orders.parquet*")
    path = scratch_path(spark, "combinations")
    write_snapshots(running_combinations(stream, ["o_orderstatus", "o_orderpriority"]), path, scratch_path(spark, "stream")).awaitTermination()
    return read_snapshot(spark, path)
