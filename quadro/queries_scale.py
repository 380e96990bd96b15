"""Registered queries on order without one task, large rule tables, maps, files and streams in parts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadro.functions.coerce import as_key, to_number
from quadro.functions.formula import formula
from quadro.operators import places
from quadro.operators import profiling as prof
from quadro.operators import statistics as st
from quadro.operators import tableops as ops
from quadro.operators import transform as tr
from quadro.operators.ordered import limited
from quadro.operators.predicates import classify
from quadro.operators.tabulate import headline_totals, tabulate, totals
from quadro.plans.spec import Category, CodeRange, Conversion, Dimension, Filter, TabulationSpec
from quadro.queries import SQL, query, table
from quadro.queries_tables import prof_numeric  # noqa: F401  (its SQL is used again)
from quadro.sources.dbf import read_dbf, write_dbf_files
from quadro.sources.delimited import read_delimited
from quadro.sources.scratch import scratch_path
from quadro.streaming.tables import read_profile, write_profile

# --- order ------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice, 2) AS price, (SELECT count(*) FROM lineitem) AS seen, (SELECT count(*) FROM lineitem) > 2500 AS truncated
FROM (SELECT *, row_number() OVER () AS k FROM lineitem) WHERE k <= 2500""")
def rec_limit(spark, sf):
    """The first 2,500 records as the source holds them, how many there are, and whether some were cut."""
    rows, counters = limited(table(spark, sf, "lineitem"), 2500)
    return rows.join(F.broadcast(counters)).select("l_orderkey", "l_linenumber", "l_partkey", F.round("l_extendedprice", 2).alias("price"), "seen", "truncated")


LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@query(f"""WITH o AS (SELECT *, lag(l_quantity) OVER w AS a, lag(l_quantity, 40) OVER w AS b FROM lineitem WINDOW w AS (ORDER BY {", ".join(LINES)}))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity - a AS step, coalesce(l_quantity / b, -1) AS far FROM o""")
def fx_lag_records(spark, sf):
    """Formulas that look one and forty records back over the whole table."""
    d = table(spark, sf, "lineitem").select(*LINES)
    made = {"step": "l_quantity - LAG(l_quantity)", "far": "IFERROR(l_quantity / LAG(l_quantity; 40), -1)"}
    d, before = tr.with_lags(d, list(made.values()), LINES, LINES)
    values = {c: to_number(F.col(c), d.schema[c].dataType) for c in LINES}
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *[formula(f, values, on_error="null", order=before).alias(n) for n, f in made.items()])


@query("""WITH c AS (SELECT o_custkey AS k, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) AS a, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY 1),
d AS (SELECT k, a, n, sum(a) OVER () - a AS b, sum(n) OVER () - n AS m FROM c), z AS (SELECT k, (a / n - b / m) / sqrt((a + b) / (n + m) * (1 - (a + b) / (n + m)) * (1 / n + 1 / m)) AS z FROM d),
x AS (SELECT k, z, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z),
p AS (SELECT k, 2 * (1 - (1 + 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-x * x)) / 2) AS p FROM x),
r AS (SELECT k, p, p * count(*) OVER () / row_number() OVER (ORDER BY p, k) AS raw FROM p)
SELECT k, round(p, 6) AS p, round(least(1, min(raw) OVER (ORDER BY p, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM r""")
def stat_bh_many(spark, sf):
    """A test for every customer, adjusted for their number."""
    c = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count(F.lit(1)).alias("n"))
    s = F.broadcast(c.agg(F.sum("a").alias("sa"), F.sum("n").alias("sn")))
    d = c.join(s).select("k", "a", "n", (F.col("sa") - F.col("a")).alias("b"), (F.col("sn") - F.col("n")).alias("m"))
    found = st.false_discovery(st.two_proportions(d, "a", "n", "b", "m"), "p", "k")
    return found.select("k", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, median(l_quantity) AS quantity, round(median(l_extendedprice), 4) AS price, median(l_discount) AS discount FROM lineitem GROUP BY 1, 2")
def pipe_group_medians(spark, sf):
    """Medians of three fields at once, of groups too large to sort."""
    names = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}
    d = tr.GroupSummarize(["l_returnflag", "l_linestatus"], [("count", None, "n"), *[("median", f, t) for t, f in names.items()]]).apply(table(spark, sf, "lineitem"))
    return d.withColumn("price", F.round("price", 4))


# --- rule tables and maps ---------------------------------------------------------------

RULES = 5000


@query(f"""WITH r AS (SELECT k, k * 37 % 60000 AS low, k * 37 % 60000 + k % 50 AS high, k % 97 + 1 AS s FROM range({RULES}) t(k)), o AS (SELECT DISTINCT o_orderkey % 100000 AS c FROM orders),
m AS (SELECT c, arg_min(s, k) AS first, arg_max(s, k) AS last FROM o JOIN r ON c BETWEEN low AND high GROUP BY c)
SELECT o_orderkey, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM orders LEFT JOIN m ON c = o_orderkey % 100000""")
def cnv_many_ranges(spark, sf):
    """5,000 ranges that overlap, read by both precedences."""
    rules = tuple(CodeRange(k % 97 + 1, f"{k * 37 % 60000:06}", f"{k * 37 % 60000 + k % 50:06}") for k in range(RULES))
    kinds = tuple(Category(s, f"c{s}") for s in range(1, 98))
    d = table(spark, sf, "orders").select("o_orderkey", F.lpad((F.col("o_orderkey") % 100000).cast("string"), 6, "0").alias("code"))
    by = {p: classify(d, "code", Conversion("ranges", kinds, rules, precedence=p, code_length=6)).alias(p) for p in ("first", "last")}
    return d.select("o_orderkey", by["first"], by["last"])


def _map(spark, sf) -> DataFrame:
    """An object for each part: a box, with a hole where p_size > 25; every tenth is a line, every eleventh a point."""
    k, size = F.col("p_partkey"), F.col("p_size")
    x0, y0 = k * 37 % 10000 - 1000 + 0.005, k * 7 % 25 - 0.5
    x1, y1 = x0 + 50 + size * 20, y0 + 1 + size % 5
    ring = lambda a, z, b, t: F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in ((a, b), (z, b), (z, t), (a, t))])
    hole = ring(x0 + 20, x0 + 60, y0, y1)
    kind = F.when(k % 10 == 0, "line").when(k % 11 == 0, "point").otherwise("polygon")
    outer = ring(x0, x1, y0, y1)
    return table(spark, sf, "part").select(k.alias("ord"), F.concat(F.lit("p"), k).alias("key"), kind.alias("type"), F.when(size > 25, F.array(outer, hole)).otherwise(F.array(outer)).alias("parts"))


@query("""WITH o AS (SELECT p_partkey AS k, p_size AS s, p_partkey * 37 % 10000 - 1000 + 0.005 AS x0, p_partkey * 7 % 25 - 0.5 AS y0 FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 11 <> 0),
b AS (SELECT k, s, x0, x0 + 50 + s * 20 AS x1, y0, y0 + 1 + s % 5 AS y1 FROM o),
h AS (SELECT c_custkey, max(k) AS k FROM customer JOIN b ON c_acctbal BETWEEN x0 AND x1 AND c_nationkey BETWEEN y0 AND y1 AND NOT (s > 25 AND c_acctbal BETWEEN x0 + 20 AND x0 + 60) GROUP BY 1)
SELECT c.c_custkey, 'p' || k AS object FROM customer c LEFT JOIN h ON h.c_custkey = c.c_custkey""")
def map_objects(spark, sf):
    """The last object of a map of all parts that each customer is on."""
    points = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("y"))
    return places.objects_at(points, _map(spark, sf)).select("c_custkey", "object")


# --- values that aren't finite ----------------------------------------------------------

ODD = {0: ("Infinity", math.inf), 1: ("NaN", math.nan), 2: ("1000000000000000000", 1e18), 3: ("1.5e+21", 1.5e21), 4: ("1e-7", 1e-7), 5: ("2500000000000000", 2.5e15), 6: ("-Infinity", -math.inf), 7: ("0.1", 0.1), 8: ("-12", -12.0)}
_SHOWN = " ".join(f"WHEN {k} THEN '{text}'" for k, (text, _) in ODD.items())


def _odd(k):
    return F.coalesce(*[F.when(k % len(ODD) == n, F.lit(v)) for n, (_, v) in ODD.items()])


@query(f"SELECT CASE o_orderkey % {len(ODD)} {_SHOWN} END AS row_key, o_orderstatus AS col_key, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2")
def tab_odd_numbers(spark, sf):
    """An axis of doubles that are very large, very small, infinite or none."""
    d = table(spark, sf, "orders").select("o_orderstatus", _odd(F.col("o_orderkey")).alias("v"))
    return tabulate(d, TabulationSpec(Dimension("v"), Dimension("o_orderstatus"))).cells.where("value > 0").select("row_key", "col_key", "value")


def _spiked(spark, sf) -> DataFrame:
    """Events of which every fiftieth has no finite value."""
    e, k = table(spark, sf, "events"), F.col("event_id")
    v = F.when(k % 50 == 0, F.lit(math.inf)).when(k % 50 == 1, F.lit(-math.inf)).otherwise(F.col("value"))
    return e.select("event_id", v.alias("value"))


@query("""WITH e AS (SELECT CASE WHEN event_id % 50 > 1 THEN value END AS v FROM events), q AS (SELECT quantile_cont(v, 0.25) AS q1, median(v) AS m, quantile_cont(v, 0.75) AS q3 FROM e)
SELECT (SELECT count(*) FROM e) AS total, (SELECT count(v) FROM e) AS numeric, (SELECT count(*) FROM events WHERE event_id % 50 <= 1) AS invalid, round(m, 6) AS median, (SELECT count(*) FROM e WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers FROM q""")
def prof_infinite(spark, sf):
    return prof.numeric_profile(_spiked(spark, sf), "value").select("total", "numeric", "invalid", F.round("median", 6).alias("median"), "outliers")


@query("""WITH e AS (SELECT event_id, value AS v FROM events WHERE event_id % 50 > 1), q AS (SELECT quantile_cont(v, 0.25) AS q1, median(v) AS m, quantile_cont(v, 0.75) AS q3 FROM e), a AS (SELECT median(abs(v - m)) AS mad FROM e, q)
SELECT event_id, round(v, 6) AS value, round(0.67448975 * (v - m) / mad, 6) AS z FROM e, q, a WHERE abs(0.67448975 * (v - m) / mad) >= 3.5 OR v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)""")
def anom_infinite(spark, sf):
    d = prof.numeric_outliers(_spiked(spark, sf), "value", ["event_id"])
    return d.select("event_id", F.round("value", 6).alias("value"), F.round("z", 6).alias("z"))


@query("""WITH e AS (SELECT value AS v FROM events WHERE event_id % 50 > 1), l AS (SELECT min(v) AS lo, max(v) AS hi FROM e)
SELECT CAST(least(4, greatest(0, ceil((v - lo) / (hi - lo) * 5) - 1)) AS INTEGER) AS class, count(*) AS n FROM e, l GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM events WHERE event_id % 50 <= 1""")
def map_infinite(spark, sf):
    """Classes of equal width; what isn't finite is in none."""
    d = _spiked(spark, sf)
    limits = places.class_limits(d, "value", "equal", 5)
    return d.groupBy(places.class_of(F.col("value"), limits).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT CASE o_orderkey % {len(ODD)} {_SHOWN} END AS v FROM orders")
def pipe_odd_keys(spark, sf):
    d = table(spark, sf, "orders").select("o_orderkey", _odd(F.col("o_orderkey")).alias("v"))
    kept = tr.Dedupe(["v"], ["o_orderkey"]).apply(d)
    return kept.select(as_key(F.col("v"), d.schema["v"].dataType).alias("v"))


# --- files in parts -----------------------------------------------------------------------


@query("SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars, lang, sha256(trim(text)) AS text_sha256 FROM documents WHERE trim(text) <> ''")
def src_delimited_splits(spark, sf):
    """Whole texts, with line ends and quotes in quotes, written by the tasks that read them; many tasks read each file."""
    path = scratch_path(spark, "quoted")
    d = table(spark, sf, "documents").where("trim(text) <> ''").select(F.concat(F.lit("d"), "doc_id").alias("doc_id"), "n_chars", "lang", "text")
    d.write.option("quoteAll", True).option("escape", '"').csv(path, sep=";", header=True)
    back = read_delimited(spark, path, range_bytes=1 << 18)
    return back.select(F.substring("doc_id", 2, 20).cast("bigint").alias("doc_id"), "n_chars", "lang", F.sha2("text", 256).alias("text_sha256"))


@query("SELECT CAST(l_orderkey AS DOUBLE) AS id, CAST(l_linenumber AS DOUBLE) AS line, l_returnflag AS flag, l_quantity AS quantity FROM lineitem")
def src_dbf_ranges(spark, sf):
    """DBF files of all records, written by the tasks that read them; four of five fields read by ranges of records."""
    path = scratch_path(spark, "dbf")
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_linestatus").alias("mode"))
    write_dbf_files(d, path, {"flag": 1, "mode": 10, "id": 10, "line": 2, "quantity": 10}, {"quantity": 2}, most=10_000_000)
    return read_dbf(spark, path, ["id", "line", "flag", "quantity"], range_bytes=1 << 20)


@query("SELECT CAST(o_orderkey AS DOUBLE) AS id, o_orderstatus AS status, o_totalprice AS price, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def src_dbc(spark, sf):
    """A table as compressed files, written by tasks and expanded by others."""
    path = scratch_path(spark, "dbc")
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").alias("day"))
    write_dbf_files(d, path, {"id": 10, "status": 1, "price": 14}, {"price": 2}, most=20_000, packed=True)
    return read_dbf(spark, path).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


# --- streams ------------------------------------------------------------------------------


@query(SQL["prof_numeric"])
def stream_profile(spark, sf):
    """The profile of a stream of events after its last batch: of its values, not of what each batch was."""
    path, source = scratch_path(spark, "profile"), scratch_path(spark, "arriving")
    events = table(spark, sf, "events")
    events.repartition(5, "event_id").write.parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    write_profile(stream, "value", path, scratch_path(spark, "stream")).awaitTermination()
    d = read_profile(spark, path)
    return d.withColumns({c: F.round(c, 6) for c, t in d.dtypes if t == "double"})


# --- comparisons, shares and audits in whole ------------------------------------------------


def _two_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers by nation: nations of the second are called otherwise or are absent."""
    n = table(spark, sf, "nation")
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    b = table(spark, sf, "supplier").where("s_nationkey <> 3").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    label = F.when(F.col("n_nationkey") % 5 == 1, F.lower("n_name")).otherwise(F.col("n_name"))
    left = a.join(n, F.col("k") == F.col("n_nationkey")).where("k <> 7").select(F.col("k").cast("string").alias("row_key"), F.col("n_name").alias("row_label"), "v")
    right = b.join(n, F.col("k") == F.col("n_nationkey")).select(F.col("k").cast("string").alias("row_key"), label.alias("row_label"), "v")
    return left, right


_BOTH = """a AS (SELECT DISTINCT c_nationkey AS k, n_name AS l FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey <> 7),
b AS (SELECT DISTINCT s_nationkey AS k, CASE WHEN s_nationkey % 5 = 1 THEN lower(n_name) ELSE n_name END AS l FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey <> 3)"""


@query(f"""WITH {_BOTH}, m AS (SELECT a.k AS x, b.k AS y, a.l <> b.l AS d FROM a FULL JOIN b ON a.k = b.k),
s AS (SELECT (SELECT count(*) FROM a) AS left_rows, (SELECT count(*) FROM b) AS right_rows, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS matched_rows, count(*) FILTER (WHERE y IS NULL) AS left_only_rows,
count(*) FILTER (WHERE x IS NULL) AS right_only_rows, count(*) FILTER (WHERE d) AS label_mismatches FROM m)
SELECT *, round(matched_rows / left_rows, 9) AS left_coverage, round(matched_rows / right_rows, 9) AS right_coverage,
left_only_rows || ' row(s) on the left only, ' || right_only_rows || ' on the right only; ' || label_mismatches || ' matched row(s) have different labels' AS warnings FROM s""")
def cmp_diagnostics(spark, sf):
    d, _ = ops.compare_diagnostics(*_two_tables(spark, sf), how="full")
    return d.withColumns({"left_coverage": F.round("left_coverage", 9), "right_coverage": F.round("right_coverage", 9), "warnings": F.array_join("warnings", "; ")})


@query(f"WITH {_BOTH} SELECT CAST(a.k AS VARCHAR) AS row_key, CAST(b.k AS VARCHAR) AS other_key, a.l AS row_label, b.l AS other_label FROM a JOIN b ON a.k = b.k AND a.l <> b.l")
def cmp_label_mismatches(spark, sf):
    return ops.compare_diagnostics(*_two_tables(spark, sf))[1]


@query("""WITH c AS (SELECT o_orderpriority AS key, count(*) FILTER (WHERE o_orderstatus = 'P') AS a, count(*) FILTER (WHERE o_orderstatus <> 'P') AS b FROM orders GROUP BY 1), s AS (SELECT *, a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM c)
SELECT key, a AS left_count, b AS right_count, round(p, 9) AS left_share, round(q, 9) AS right_share, round(p - q, 9) AS difference, round(CASE WHEN p > 0 AND q > 0 THEN log2(p / q) END, 9) AS log2_lift FROM s""")
def anom_lift(spark, sf):
    o = table(spark, sf, "orders")
    d = prof.distribution_rows(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus <> 'P'"), "o_orderpriority")
    return d.withColumns({c: F.round(c, 9) for c, t in d.dtypes if t == "double"})


@query("""WITH c AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) SELECT (SELECT CAST(k AS VARCHAR) FROM c ORDER BY n DESC, CAST(k AS VARCHAR) LIMIT 1) AS top_key, round(max(n) / sum(n), 9) AS top_share, count(*) AS "values" FROM c""")
def anom_top_key(spark, sf):
    return prof.concentration(table(spark, sf, "lineitem"), "l_suppkey").select("top_key", F.round("top_share", 9).alias("top_share"), "values")


_ORDERS = """d AS (SELECT o_orderstatus = 'P' AS g, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 <> 0 THEN '3' ELSE CAST(o_custkey % 25 AS VARCHAR) END AS place, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 97 = 0 THEN o_totalprice * 40 ELSE o_totalprice END AS price,
CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS DOUBLE) END AS cust FROM orders),
n AS (SELECT CAST(count(*) FILTER (WHERE g) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE NOT g) AS DOUBLE) AS m FROM d)"""


def _marked_orders(spark, sf) -> DataFrame:
    p = F.col("o_orderstatus") == "P"
    place = F.when(p & (F.col("o_orderkey") % 4 != 0), "3").otherwise((F.col("o_custkey") % 25).cast("string"))
    price = F.when(p & (F.col("o_orderkey") % 97 == 0), F.col("o_totalprice") * 40).otherwise(F.col("o_totalprice"))
    return table(spark, sf, "orders").select(p.alias("p"), place.alias("place"), price.alias("price"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey").cast("double")).alias("cust"), F.lit("?").alias("none"))


def _outlier_sql(name: str) -> str:
    return f"""SELECT '{name}' AS field, 'outlier' AS kind, NULL AS key, round(k / n, 6) AS group_share, round(z, 6) AS effect FROM (SELECT count(*) AS k, max(abs(0.67448975 * (v - m) / mad)) AS z FROM (SELECT {name} AS v FROM d WHERE g AND {name} IS NOT NULL),
(SELECT quantile_cont({name}, 0.25) AS q1, median({name}) AS m, quantile_cont({name}, 0.75) AS q3 FROM d WHERE g), (SELECT median(abs({name} - (SELECT median({name}) FROM d WHERE g))) AS mad FROM d WHERE g)
WHERE abs(0.67448975 * (v - m) / mad) >= 3.5 OR v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)), n WHERE k > 0"""


@query(f"""WITH {_ORDERS}, c AS (SELECT place AS key, CAST(count(*) FILTER (WHERE g) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE NOT g) AS DOUBLE) AS b FROM d GROUP BY 1)
SELECT 'place' AS field, 'concentration' AS kind, key, round(a / n, 6) AS group_share, round(a / n - b / m, 6) AS effect FROM c, n WHERE a / n - b / m >= 0.1 UNION ALL {_outlier_sql("price")} UNION ALL {_outlier_sql("cust")}""")
def anom_audit_whole(spark, sf):
    """An audit of places and numbers: half of the group's orders are in one place, some prices are forty times what they were."""
    s = prof.audit(_marked_orders(spark, sf), F.col("p"), [], ["price", "cust"], ["place"])
    return s.select("field", "kind", "key", F.round("group_share", 6).alias("group_share"), F.round("effect", 6).alias("effect"))


@query(f"WITH {_ORDERS} SELECT count(*) FILTER (WHERE g) AS group_records, count(*) FILTER (WHERE NOT g) AS reference_records, CAST(3 AS INTEGER) AS fields_analyzed, 'none' AS skipped, 'none: no number in the group' AS warnings FROM d")
def anom_audit_diagnostics(spark, sf):
    d = prof.audit_diagnostics(_marked_orders(spark, sf), F.col("p"), [], ["price", "cust", "none"], ["place"])
    return d.withColumns({"skipped": F.array_join("skipped", ","), "warnings": F.array_join("warnings", ",")})


@query("""SELECT 'Frequência' AS measure, CAST(count(*) FILTER (WHERE l_quantity >= 20) AS DOUBLE) AS total, count(DISTINCT CASE WHEN l_quantity >= 20 THEN l_suppkey END) AS categories, count(*) AS seen, count(*) FILTER (WHERE l_quantity >= 20) AS accepted FROM lineitem""")
def tab_headline_totals(spark, sf):
    spec = TabulationSpec(Dimension("l_suppkey"), filters=(Filter("l_quantity", low=20),))
    return headline_totals(tabulate(table(spark, sf, "lineitem"), spec, counted=True), "Frequência")


@query("SELECT o_orderpriority AS col_key, NULL AS none, round(sum(o_totalprice), 2) AS given FROM orders GROUP BY 1")
def tab_totals_given(spark, sf):
    """No totals, and totals that come with the table."""
    o = table(spark, sf, "orders")
    cells = tabulate(o, TabulationSpec(Dimension("o_orderstatus"), Dimension("o_orderpriority"))).cells
    given = o.groupBy(F.col("o_orderpriority").alias("col_key")).agg(F.sum("o_totalprice").alias("total"))
    none = totals(cells, "none").withColumnRenamed("total", "none")
    return none.join(totals(cells, "precalculated", given=given).withColumnRenamed("total", "given"), "col_key").select("col_key", "none", F.round("given", 2).alias("given"))
