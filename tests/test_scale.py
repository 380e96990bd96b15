"""Order, medians, rule tables, maps, counters, files and streams that no single task carries."""

import csv
import io
import math
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadro.functions.coerce import as_key
from quadro.functions.formula import FormulaError, formula, lags, references
from quadro.operators import ordered, places, profiling, statistics, tableops
from quadro.operators import transform as tr
from quadro.operators.predicates import classify, matches
from quadro.operators.tabulate import tabulate
from quadro.plans.spec import Category, CodeRange, Conversion, Dimension, Filter, Measure, PlanError, TabulationSpec
from quadro.sources import archives, definitions
from quadro.sources.dbf import expand_dbc, pack_dbc, read_dbf, write_dbf_files
from quadro.sources.delimited import read_delimited
from quadro.streaming import tables, versions


def plan_of(d):
    return d._jdf.queryExecution().executedPlan().toString()


# --- order ------------------------------------------------------------------------------


def test_numbers_follow_the_order_whatever_the_ranges(spark):
    r = random.Random(1)
    data = [(r.choice([None, 1, 1, 1, 5]), k) for k in range(500)]
    got = ordered.numbered(spark.createDataFrame(data, "a int, b int").repartition(7), [F.col("a").desc_nulls_last(), F.col("b").asc()]).collect()
    want = sorted(data, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.ordinal)] == want
    assert [x.ordinal for x in sorted(got, key=lambda x: x.ordinal)] == list(range(500))
    assert ordered.numbered(spark.createDataFrame([], "a int"), [F.col("a")]).count() == 0


def test_lags_of_any_distance(spark):
    d = spark.createDataFrame([(k, float(k * k)) for k in range(200)], "k int, v double").repartition(5)
    out = ordered.lagged(d, [F.col("k")], {"one": ("v", 1), "far": ("v", 150), "next": ("v", -1), "k1": ("k", 1)})
    got = {r.k: r for r in out.collect()}
    assert all((got[k].one, got[k].far, got[k].next) == (float((k - 1) ** 2) if k else None, float((k - 150) ** 2) if k >= 150 else None, float((k + 1) ** 2) if k < 199 else None) for k in range(200))
    assert "SinglePartition" not in plan_of(out)


def test_a_limit_takes_the_first_records_of_the_source(spark, tmp_path):
    for k in range(3):
        spark.range(k * 100, k * 100 + 100, numPartitions=1).write.parquet(str(tmp_path / f"f{k}"))
    d = spark.read.parquet(*[str(tmp_path / f"f{k}") for k in (0, 1, 2)])
    rows, counters = ordered.limited(d, 150)
    assert sorted(r.id for r in rows.collect()) == list(range(150)) and tuple(counters.first()) == (300, 150, True)
    rows, counters = ordered.limited(d.where("id % 3 = 0"), 40)  # what a filter has left
    assert sorted(r.id for r in rows.collect()) == list(range(0, 120, 3)) and tuple(counters.first()) == (100, 40, True)
    rows, counters = ordered.limited(spark.range(5), 10)
    assert rows.count() == 5 and tuple(counters.first()) == (5, 5, False)
    assert tuple(ordered.limited(spark.range(0), 3)[1].first()) == (0, 0, False)
    assert [r.id for r in ordered.limited(spark.range(9), 2, [F.col("id").desc()])[0].orderBy("id").collect()] == [7, 8]
    with pytest.raises(ValueError, match="limit"):
        ordered.limited(d, -1)


def test_lag_in_a_pipeline_and_what_it_refuses(spark):
    d = spark.createDataFrame([(k, float(k)) for k in range(30)], "k int, v double").repartition(4)
    made = tr.Derive("x", "IFERROR(v - LAG(v; 3), 99)", order=["k"]).apply(d)
    assert {r.k: r.x for r in made.collect()} == {k: 3.0 if k >= 3 else 99.0 for k in range(30)}
    assert made.columns == ["k", "v", "x"] and "SinglePartition" not in plan_of(made)
    assert lags("lag([v]) + LAG(k, 2)", ["k", "v"]) == [("v", 1), ("k", 2)]
    for bad in ("LAG(v, 0)", "LAG(v, k)", "LAG(v, 1.5)"):
        with pytest.raises(FormulaError, match="positive whole"):
            tr.Derive("x", bad, order=["k"]).apply(d)
    with pytest.raises(FormulaError, match="order"):
        tr.Derive("x", "LAG(v)").apply(d)


def test_adjusted_p_values_with_ties_and_nulls(spark):
    r = random.Random(2)
    p = [r.choice([0.01, 0.2, 1.0, r.random(), r.random() / 100]) for _ in range(300)] + [None] * 5
    d = spark.createDataFrame(list(enumerate(p)), "k int, p double").repartition(6)
    out = statistics.false_discovery(d, "p", "k")
    got = {x.k: x.q for x in out.collect()}
    given = [x for x in p if x is not None]
    order = np.argsort(given, kind="stable")
    raw = np.array(given)[order] * len(given) / np.arange(1, len(given) + 1)
    q = np.empty(len(given))
    q[order] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
    assert [got[k] for k in range(300)] == pytest.approx(q.tolist(), rel=1e-12) and all(got[k] is None for k in range(300, 305))


# --- medians ----------------------------------------------------------------------------


@pytest.mark.parametrize("gathered", [3, 50, 1 << 14])
def test_medians_of_groups_of_any_size(spark, monkeypatch, gathered):
    monkeypatch.setattr(statistics, "GATHERED", gathered)
    r = random.Random(3)
    groups = {None: [r.gauss(0, 1) for _ in range(120)], "two ties": [0.0] * 200 + [r.random() for _ in range(60)] + [1.0] * 200, "one": [4.0], "same": [2.5] * 90, "even": [1.0, 2.0], "wide": [r.lognormvariate(0, 9) for _ in range(151)], "empty": []}
    rows = [(g, v, -v) for g, x in groups.items() for v in x] + [("empty", None, 1.0), ("even", None, None)]
    d = spark.createDataFrame(rows, "g string, v double, w double").repartition(5)
    got = {x.g: (x.a, x.b) for x in statistics.grouped_quantiles(d, ["g"], {"a": F.col("v"), "b": F.col("w")}, 0.5).collect()}
    for g, x in groups.items():
        if x:
            assert got[g] == pytest.approx((np.median(x), -np.median(x)), rel=1e-12)
    assert got["empty"] == (None, 1.0)
    low = {x.g: x.a for x in statistics.grouped_quantiles(d, ["g"], {"a": F.col("v")}, 0.1).collect()}
    assert all(low[g] == pytest.approx(np.quantile(x, 0.1), rel=1e-12) for g, x in groups.items() if x)
    assert statistics.grouped_quantiles(d, [], {"a": F.col("v")}, 0.5).first().a == pytest.approx(np.median([v for x in groups.values() for v in x]))
    assert tr.GroupSummarize(["g"], [("median", "v", "m"), ("count", None, "n")]).apply(d).where("g is null").first().asDict() == {"g": None, "m": pytest.approx(np.median(groups[None])), "n": 120}


def test_quantiles_between_two_huge_ties(spark, monkeypatch):
    monkeypatch.setattr(statistics, "SORTED", 10)
    monkeypatch.setattr(statistics, "ACCURACY", 20)
    values = [0.0] * 3000 + [k / 1000 for k in range(1, 400)] + [1.0] * 3000
    d = spark.createDataFrame([(v,) for v in values], "v double")
    assert statistics.exact_quantiles(d, F.col("v"), [0.5, 0.48, 0.1]) == pytest.approx(np.quantile(values, [0.5, 0.48, 0.1]).tolist())


def test_quantiles_of_counted_values(spark):
    r = random.Random(4)
    counts = {float(v): r.randint(1, 9) for v in range(-40, 40)}
    d = spark.createDataFrame([*counts.items(), (None, 7)], "v double, n bigint").repartition(3)
    flat = [v for v, n in counts.items() for _ in range(n)]
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    assert statistics.counted_quantiles(d, shares) == pytest.approx(np.quantile(flat, shares).tolist())
    assert statistics.counted_quantiles(d.where("v is null"), [0.5]) == [None]


# --- rule tables and maps ---------------------------------------------------------------


@pytest.mark.parametrize("precedence", ["first", "last"])
def test_many_overlapping_ranges_as_one_rule_at_a_time(spark, precedence):
    r = random.Random(5)
    word = lambda: "".join(r.choice("0123Aé") for _ in range(r.randint(1, 3)))
    rules = []
    for k in range(400):
        a, b = word(), word()
        rules.append(CodeRange(k % 11, a, a if k % 3 == 0 else b))  # some ranges are empty
    c = Conversion("x", tuple(Category(s, str(s)) for s in range(11)), tuple(rules), precedence=precedence, code_length=3)
    codes = sorted({word() for _ in range(300)} | {""})
    got = {x.code: x.s for x in spark.createDataFrame([(x,) for x in codes], "code string").select("code", classify(spark.createDataFrame([], "code string"), "code", c).alias("s")).collect()}
    for x in codes:
        hits = [q.sequence for q in rules if q.low.encode() <= x.encode() <= q.high.encode()]
        assert got[x] == (None if not hits else hits[0] if precedence == "first" else hits[-1]), x
    none = Conversion("x", (Category(1, "a"),), tuple(CodeRange(1, "9", "0") for _ in range(300)), code_length=1)
    assert spark.createDataFrame([("5",)], "code string").select(classify(spark.createDataFrame([], "code string"), "code", none).alias("s")).first().s is None
    plan = plan_of(spark.createDataFrame([("5",)], "code string").select(classify(spark.createDataFrame([], "code string"), "code", c).alias("s")))
    assert plan.count("CASE WHEN") < 12


MAP = "ord bigint, key string, type string, parts array<array<struct<x: double, y: double>>>"


def crossed(x, y, ring):
    hit = False
    for k, (ax, ay) in enumerate(ring):
        bx, by = ring[k - 1]
        hit ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return hit


def test_points_meet_the_last_object_that_holds_them(spark):
    r = random.Random(6)
    objects = []
    for k in range(120):
        size = r.choice([0.01, 1, 1, 30, 5000])
        x, y = r.uniform(-40, 40), r.uniform(-40, 40)
        ring = [(x + size * math.cos(a) * r.uniform(0.4, 1), y + size * math.sin(a) * r.uniform(0.4, 1)) for a in np.linspace(0, 2 * math.pi, r.randint(3, 8), endpoint=False)]
        hole = [(x + (a - x) / 3, y + (b - y) / 3) for a, b in ring]
        kind = r.choice(["polygon", "polygon", "polygon", "line", "point"])
        objects.append((k // 2, f"o{k}", kind, [ring, hole] if r.random() < 0.4 else [ring]))
    objects += [(200, "none", "polygon", []), (201, "same", "point", [[(1.5, 2.5)]])]
    points = [(k, r.uniform(-50, 50), r.uniform(-50, 50)) for k in range(300)] + [(300, 1.5, 2.5), (301, 1.5, 2.5), (302, None, 1.0), (303, math.inf, 1.0), (304, 0.0, math.nan), (305, *objects[0][3][0][0])]
    d = places.objects_at(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame([(a, b, c, [[{"x": x, "y": y} for x, y in ring] for ring in p]) for a, b, c, p in objects], MAP))
    got = {x.id: x.object for x in d.collect()}

    def holds(o, x, y):
        if o[2] == "point":
            return bool(o[3]) and o[3][0][0] == (x, y)
        return o[2] == "polygon" and sum(crossed(x, y, ring) for ring in o[3]) % 2 == 1

    for k, x, y in points:
        bad = x is None or not math.isfinite(x) or not math.isfinite(y)
        hits = [] if bad else [(o[0], o[1]) for o in objects if holds(o, x, y)]
        assert got[k] == (max(hits)[1] if hits else None), k
    assert len(got) == len(points) and "CartesianProduct" not in plan_of(d) and "BroadcastNestedLoopJoin" not in plan_of(d)
    empty = places.objects_at(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame([], MAP))
    assert empty.where("object is not null").count() == 0 and empty.count() == len(points)


# --- counters ---------------------------------------------------------------------------


def test_counters_come_with_the_table(spark):
    d = spark.createDataFrame([("a", "1"), ("a", "x"), ("b", None), (None, "3"), ("c", "4")], "k string, v string")
    spec = TabulationSpec(Dimension("k"), measures=(Measure("sum", "v"),), filters=(Filter("k", "exclude", categories=("c",)),))
    counted, plain = tabulate(d, spec, counted=True), tabulate(d, spec)
    assert counted.counters().first().asDict() == plain.counters().first().asDict() == {"seen": 5, "accepted": 3, "not_numbers_v": 1}
    cells = lambda t: sorted(map(tuple, t.cells.collect()))
    assert cells(counted) == cells(plain)
    nothing = tabulate(d.limit(0), spec, counted=True)
    assert tuple(nothing.counters().first()) == (0, 0, 0) and nothing.cells.count() == 0


def test_counts_of_steps_from_one_run(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    steps = [tr.Step("half", tr.FilterRows([Filter("id", low=50)])), tr.Step("off", tr.SelectColumns([]), enabled=False), tr.Step("ten", tr.FilterRows([Filter("id", low=90)]))]
    assert [tuple(r) for r in tr.step_counts(d, steps).collect()] == [("half", 100, 50), ("ten", 50, 10)]


def test_counts_of_a_join_with_blank_and_repeated_keys(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",), (None,), (" ",)], "k string")
    b = spark.createDataFrame([("x",), ("z",), ("z",), ("",)], "k string")
    assert tuple(tr.Join(b, [("k", "k")]).counts(a).first()) == (2, 3, 3, 3)


# --- values -----------------------------------------------------------------------------


def test_text_forms_of_every_double(spark):
    want = {math.inf: "Infinity", -math.inf: "-Infinity", math.nan: "NaN", 1e18: "1000000000000000000", -1e18: "-1000000000000000000", 123456789012345680000.0: "123456789012345680000", 1e21: "1e+21", 1.5e300: "1.5e+300", 1e-7: "1e-7", 2.5e-10: "2.5e-10", 0.1: "0.1", 1e-6: "0.000001", 1e15: "1000000000000000", 0.0: "0", -0.0: "0", 3.0: "3", 1234567.125: "1234567.125"}
    d = spark.createDataFrame([(v,) for v in want], "v double")
    assert [r[0] for r in d.select(as_key(F.col("v"), T.DoubleType())).collect()] == list(want.values())


def test_what_is_not_finite_is_left_out(spark):
    d = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 2.0, 3.0, 4.0, 100.0, math.inf, -math.inf, math.nan, None])], "k int, v double")
    p = profiling.numeric_profile(d, "v").first()
    assert (p.total, p.numeric, p.missing, p.invalid, p.max) == (9, 5, 1, 3, 100.0)
    assert [r.value for r in profiling.numeric_outliers(d, "v", ["k"]).collect()] == [100.0]
    assert places.class_limits(d, "v", "equal", 3) == [1.0, 34.0, 67.0, 100.0]


def test_reasons_where_there_is_no_result(spark):
    d = spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, 3.0, 6.0)], "c double, v double, w double")
    for f in (statistics.pearson, statistics.regression):
        with pytest.raises(Exception, match="constant"):
            f(d, "c", "v").collect()
        with pytest.raises(Exception, match="two finite pairs"):
            f(d.limit(1), "v", "w").collect()
    assert statistics.pearson(d, "v", "w").first().pearson == pytest.approx(1.0)
    t = statistics.two_proportions(spark.createDataFrame([(3, 10, 5, 5), (3, 10, 2, 5)], "a int, n int, b int, m int"), "a", "n", "b", "m").collect()
    assert t[0].odds_ratio is None and t[1].odds_ratio == pytest.approx(3 * 3 / (2 * 7)) and t[1].low < 0.3 < t[1].high and t[1].other_low < 0.4 < t[1].other_high


def test_row_operations_name_what_does_not_fit(spark):
    t = spark.createDataFrame([("a", "A", 1, 1.0), ("b", "B", 2, 2.0)], "row_key string, row_label string, ord int, v double")
    for f, why in (
            (lambda: tableops.suppress_rows(t, ["z"]), "no row to suppress"), (lambda: tableops.suppress_rows(t, ["a", "b"]), "one row at least"), (lambda: tableops.aggregate_rows(t, ["z"], "n", "N"), "no row to add"),
            (lambda: tableops.aggregate_rows(t, ["a"], "b", "N"), "row b exists"), (lambda: tableops.aggregate_rows(t, ["a"], "a", "N", keep=True), "row a exists")):
        with pytest.raises(Exception, match=why):
            f().collect()
    assert [r.v for r in tableops.aggregate_rows(t, ["a", "b"], "a", "N").collect()] == [3.0]
    assert [r.row_key for r in tableops.suppress_rows(t, ["a"]).collect()] == ["b"]


def test_columns_named_like_words_of_python(spark):
    d = spark.createDataFrame([(2.0, 3.0, 4.0)], "`is` double, `class` double, n double")
    values = {c: F.col(c) for c in d.columns}
    assert d.select(formula("is + class * n", values).alias("x")).first().x == 14.0
    assert sorted(references("IF(is > 1, class, [is])", d.columns)) == ["class", "is"]


def test_the_first_record_comes_whole(spark):
    d = spark.createDataFrame([("a", k, k) for k in range(40)], "k string, v int, w int").withColumn("o", F.lit(1)).repartition(8)
    r = tr.Dedupe(["k"], ["o"]).apply(d).first()
    assert r.v == r.w


# --- files ------------------------------------------------------------------------------


def random_cells(r):
    return "".join(r.choice(['a', 'é', ' ', '"', "\n", "\r\n", ",", "x1"]) for _ in range(r.randint(1, 9)))


@pytest.mark.parametrize("seed", range(4))
def test_splits_of_quoted_text_are_its_rows(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [[f"k{k}", random_cells(r), 'no "quote" here' if k % 5 == 0 else random_cells(r)] for k in range(150)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator=r.choice(["\n", "\r\n"]))
    w.writerow(["id", "a\nb", "c"])
    for row in rows:
        w.writerow(row)
    data = out.getvalue().encode()
    (tmp_path / "t.csv").write_bytes((b"\xef\xbb\xbf" if seed % 2 else b"") + data)
    for size in (7, 64, 1 << 20):
        d = read_delimited(spark, str(tmp_path / "t.csv"), range_bytes=size)
        assert d.columns == ["id", "a\nb", "c"]
        got = {x[0]: [x[1], x[2]] for x in d.collect()}
        want = {row[0]: [v.strip(" ") or None for v in row[1:]] for row in rows}
        assert got == want
    assert d.rdd.getNumPartitions() == 1 and read_delimited(spark, str(tmp_path / "t.csv"), range_bytes=200).rdd.getNumPartitions() > 5


def test_a_quote_within_a_cell_is_a_character(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a;b\n5" pipe;x\n6;"y\nz"\n')
    for size in (3, 1000):
        assert sorted(tuple(r) for r in read_delimited(spark, str(tmp_path / "t.csv"), range_bytes=size).collect()) == [('5" pipe', "x"), ("6", "y\nz")]


@pytest.mark.parametrize(("text", "why"), [("a,b\n1,2\n1,2,3\n", "columns"), ("a,b\n1\n", "columns"), ("a,b\n", "no data rows"), ('a,b\n1,"2\n', "isn't closed"), ('a,b\n1,"2"x\n', "after a closing quote"), ("", "is empty")])
def test_what_delimited_files_may_not_hold(spark, tmp_path, text, why):
    (tmp_path / "t.csv").write_text(text)
    with pytest.raises(Exception, match=why):
        read_delimited(spark, str(tmp_path / "t.csv")).collect()


def test_one_dbf_file_is_read_by_many_tasks(spark, tmp_path):
    d = spark.range(5000).selectExpr("id", "concat('n', id) AS name", "id / 4 AS v").coalesce(1)
    write_dbf_files(d, str(tmp_path / "x"), {"name": 8, "id": 8}, {"v": 2})
    back = read_dbf(spark, str(tmp_path / "x"), ["v", "id"], range_bytes=10_000)
    assert back.rdd.getNumPartitions() > 10 and back.columns == ["v", "id"]
    assert sorted((r.id, r.v) for r in back.collect()) == [(float(k), k / 4) for k in range(5000)]
    name = next((tmp_path / "x").glob("*.dbf"))
    (tmp_path / "y").mkdir()
    (tmp_path / "y/a.dbc").write_bytes(pack_dbc(name.read_bytes()))
    (tmp_path / "y/b c.dbf").write_bytes(name.read_bytes())
    assert expand_dbc((tmp_path / "y/a.dbc").read_bytes()) == name.read_bytes()
    assert read_dbf(spark, str(tmp_path / "y")).count() == 10_000
    name.write_bytes(name.read_bytes()[:-100])
    with pytest.raises(Exception, match="size"):
        read_dbf(spark, str(tmp_path / "x"), range_bytes=10_000).collect()


# --- streams ----------------------------------------------------------------------------


def test_profile_of_a_stream_after_each_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ADDED_UP", 3)
    r = random.Random(7)
    schema, path, state, source = "v string", str(tmp_path / "p"), str(tmp_path / "s"), str(tmp_path / "in")
    seen = []
    for batch in range(8):
        seen += [(r.choice([None, "", "x", "1,5", "inf", str(r.randint(0, 20)), str(r.random())]),) for _ in range(40)]
        spark.createDataFrame(seen[-40:], schema).coalesce(1).write.mode("append").parquet(source)
        tables.write_profile(spark.readStream.schema(schema).parquet(source), "v", path, state).awaitTermination()
        want = profiling.numeric_profile(spark.createDataFrame(seen, schema), "v").first()
        assert tuple(tables.read_profile(spark, path).first()) == pytest.approx(tuple(want)), batch
    assert len(versions.batches(spark, path)) <= 6 and len(versions.batches(spark, path, "sum")) == 2
    tables.write_profile(spark.readStream.schema(schema).parquet(source), "v", path, state).awaitTermination()  # nothing new
    assert tables.read_profile(spark, path).first().total == len(seen)


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    path = str(tmp_path / "p")
    d = spark.createDataFrame([(1.0, False, 2)], "v double, blank boolean, n bigint")
    versions.write(d, path, 0)
    versions.write(d, path, 1)
    versions.write(d, path, 1)
    (tmp_path / "p/batch-000000000002").mkdir()  # begun, not whole
    assert versions.batches(spark, path) == [0, 1] and tables.read_profile(spark, path).first().total == 4


def test_updates_keep_the_last_form_of_each_window(spark, tmp_path):
    source = str(tmp_path / "in")
    stream = lambda: spark.readStream.schema("ts timestamp, k string").parquet(source)
    for rows in ([("2024-01-01 10:00:00", "a")] * 3, [("2024-01-01 20:00:00", "a"), ("2024-01-05 01:00:00", "b")], [("2024-01-05 02:00:00", "b"), ("2024-01-01 01:00:00", "a")]):
        spark.createDataFrame(rows, "ts string, k string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        tables.write_updates(tables.windowed_counts(stream(), "ts", "k"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {(str(r.start)[:10], r.k): r.n for r in tables.read_updates(spark, str(tmp_path / "out"), ["start", "k"]).collect()}
    assert got == {("2024-01-01", "a"): 4, ("2024-01-05", "b"): 2}  # the late one came after its window had left the state


# --- files of definitions, archives, comparisons, audits ----------------------------------


def binary_map(objects):
    out = struct.pack("<Hffff", 100, 1, 1, 0, 0)
    for kind, code, name, x, y, points in objects:
        out += struct.pack("<BB10sB25sffH", kind, len(code), code.encode("cp1252"), len(name), name.encode("cp1252"), x, y, len(points)) + b"".join(struct.pack("<ff", *p) for p in points)
    return out


def test_binary_maps_have_types_and_rings(spark):
    square, hole = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
    data = binary_map([(0, "11", "Çá", 1, 2, square + hole), (1, "12", "seat", 9, 9, [(8, 8), (10, 8), (9, 10)]), (2, "13", "line", 0, 0, [(0, 0), (5, 5)]), (3, "14", "dot", 3.5, 3.5, [(7, 7)])])
    rows = definitions.parse_map(spark, data).collect()
    assert [(r.type, len(r.parts)) for r in rows] == [("polygon", 2), ("polygon-with-seat", 1), ("line", 1), ("point", 1)] and rows[0].name == "Çá"
    points = spark.createDataFrame([(1, 3.0, 3.0), (2, 1.6, 1.3), (3, 9.0, 9.0), (4, 3.5, 3.5), (5, 7.0, 7.0)], "id int, x double, y double")
    objects = definitions.parse_map(spark, data).select(F.col("geocode").cast("int").alias("ord"), F.col("geocode").alias("key"), "type", "parts")
    assert {r.id: r.object for r in places.objects_at(points, objects).collect()} == {1: "11", 2: None, 3: "12", 4: "14", 5: None}
    for bad, why in ((data[:-3], "ends within the points"), (data[:30], "ends within the head"), (binary_map([(4, "1", "x", 0, 0, [])]), "type 4"), (binary_map([(0, "1", "x", 0, 0, [(0, 0)] * 2)]), "polygon of 2 points")):
        with pytest.raises(PlanError, match=why):
            definitions.parse_map(spark, bad)


def test_a_menu_gives_filters_and_lookups_their_table(spark):
    menu = definitions.parse_def("A x.dbc\nS Sexo,SEXO,2,sexo.cnv\nS Nome,COD,1,nomes.dbf\nS Nada,Z\n")
    c = {"sexo.cnv": Conversion("sexo.cnv", (Category(1, "M"), Category(2, "F")), (CodeRange(1, "1", "1"), CodeRange(2, "2", "2")))}
    f = menu.filter("Sexo", c, [2])
    assert (f.field, f.categories, f.start) == ("SEXO", ("2",), 2)
    d = spark.createDataFrame([("x1",), ("x2",), ("22",)], "SEXO string")
    assert d.where(matches(d, f)).count() == 2
    for label in ("Nome", "Nada"):
        with pytest.raises(PlanError, match="can't be a filter"):
            menu.filter(label, c, [1])
    records = spark.createDataFrame([(" 1", "A "), ("1", "A"), ("2", None), ("", "x"), (None, "y")], "k string, n string")
    assert sorted(map(tuple, definitions.lookup_table(records, "k", "n").collect())) == [("1", "A"), ("2", "")]
    with pytest.raises(PlanError, match="no usable rows"):
        definitions.lookup_table(records.where("k = ''"), "k", "n")
    with pytest.raises(Exception, match="conflicting labels for the key 1"):
        definitions.lookup_table(spark.createDataFrame([("1", "A"), ("1", "B")], "k string, n string"), "k", "n").collect()


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_one_budget_covers_archives_within_archives(monkeypatch):
    inner = zipped({"a": b"0" * 600, "b": b"1" * 300})
    whole = zipped({"x.zip": inner, "y.zip": inner, "c": b"2" * 100})
    assert sum(len(d) for _, d in archives.entries(whole)) == 1900
    for name, limit in (("MOST_BYTES", 1899), ("MOST_FILE", 599), ("MOST_ENTRIES", 6), ("MOST_PACKED", len(whole) - 1)):
        with monkeypatch.context() as m:
            m.setattr(archives, name, limit)
            with pytest.raises(PlanError):
                list(archives.entries(whole))


def test_a_comparison_says_what_it_covers(spark):
    table = lambda rows: spark.createDataFrame(rows, "row_key string, row_label string, v double")
    a, b = table([("1", "A", 1.0), ("2", "B", 2.0), ("3", "C", 3.0)]), table([("1", "A", 1.0), ("2", "b", 2.0), ("9", "Z", 3.0)])
    counts, differ = tableops.compare_diagnostics(a, b, how="full")
    r = counts.first()
    assert (r.left_rows, r.right_rows, r.matched_rows, r.left_only_rows, r.right_only_rows, r.label_mismatches) == (3, 3, 2, 1, 1, 1) and r.left_coverage == pytest.approx(2 / 3) and len(r.warnings) == 2
    assert [tuple(x) for x in differ.collect()] == [("2", "2", "B", "b")]
    assert tableops.compare_diagnostics(a, b, match="label")[0].first().warnings == ["1 matched row(s) have different labels", "rows were matched by label"]
    nothing = tableops.compare_diagnostics(a.limit(0), b.limit(0), how="full")[0].first()
    assert (nothing.left_coverage, nothing.warnings) == (0.0, [])
    with pytest.raises(Exception, match="labels differ for the key 2"):
        tableops.compare_diagnostics(a, b, require_labels=True)[0].collect()


def test_outliers_of_many_fields_are_those_of_each(spark):
    r = random.Random(8)
    rows = [(r.gauss(0, 1) if k % 40 else 50.0, 5.0 if k % 9 else 6.0, str(r.lognormvariate(0, 2)), "x") for k in range(400)]
    d = spark.createDataFrame(rows, "a double, b double, c string, none string")
    got = {x.field: (x.outliers, x.largest) for x in profiling.outliers_of(d, ["a", "b", "c", "none"]).collect()}
    assert set(got) == {"a", "b", "c"}
    for name in got:
        each = profiling.numeric_outliers(d, name, []).collect()
        assert got[name] == (len(each), pytest.approx(max(abs(x.z) for x in each)))
    s = profiling.audit_diagnostics(d, F.lit(True), ["b"], ["a", "none"]).first()
    assert (s.fields_analyzed, s.skipped, len(s.warnings)) == (2, ["none"], 2)
