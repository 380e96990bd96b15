"""No step puts a whole table, file or map cell into one task."""

import random
from pathlib import Path

import pytest

import __spark_entry__
from quadro.operators import ordered, places
from quadro.sources import dbf, ranges


@pytest.fixture
def no_small_sides(spark):
    """Spark takes no side of a join for small on its own, as with large tables."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    had = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, had)


def test_a_limit_moves_no_records(spark, tmp_path, no_small_sides):
    spark.range(0, 400, numPartitions=1).write.parquet(str(tmp_path / "one"))
    rows, counters = ordered.limited(spark.read.parquet(str(tmp_path / "one")), 150)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    assert sorted(r.id for r in rows.collect()) == list(range(150)) and tuple(counters.first()) == (400, 150, True)


def rows_of_joins(node):
    """Rows that each join of an executed plan gave."""
    name = node.nodeName()
    inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(k) for k in range(node.children().size())]
    own = [node.metrics().apply("numOutputRows").value()] if "Join" in name else []
    return own + [n for x in inner for n in rows_of_joins(x)]


def test_points_meet_few_of_many_shapes_on_each_other(spark):
    r = random.Random(4)
    objects = []
    for k in range(900):  # leaning boxes, some with a hole, wider than high by far
        x, y, w, h = r.uniform(0, 300), r.uniform(0, 4), r.uniform(600, 900), r.uniform(5, 9)
        ring = [(x, y), (x + w, y + h / 9), (x + w * 0.9, y + h), (x + w / 20, y + h * 0.8)]
        hole = [(x + w / 4 + (a - x) / 5, y + h / 4 + (b - y) / 5) for a, b in ring]
        objects.append((k // 2, f"o{k}", "polygon", [ring, hole] if k % 3 == 0 else [ring]))
    objects += [(k, f"again{k}", *objects[5][2:]) for k in range(300)] + [(999, "dot", "point", [[(450.25, 4.5)]])] * 50
    points = [(k, r.uniform(-50, 1000), r.uniform(-1, 12)) for k in range(400)] + [(400, 450.25, 4.5), (401, 450.25, 4.75)]
    d = places.objects_at(
        spark.createDataFrame(points, "id int, x double, y double"),
        spark.createDataFrame([(a, b, c, [[{"x": x, "y": y} for x, y in ring] for ring in p]) for a, b, c, p in objects], "ord int, key string, type string, parts array<array<struct<x:double,y:double>>>"))
    got = {p.id: p.object for p in d.collect()}

    def crossed(x, y, ring):
        return sum((b[1] > y) != (a[1] > y) and x < (a[0] - b[0]) * (y - b[1]) / (a[1] - b[1]) + b[0] for a, b in zip(ring[-1:] + ring[:-1], ring, strict=True))

    for k, x, y in points:
        hits = [(a, b) for a, b, c, p in objects if (p[0][0] == (x, y) if c == "point" else sum(crossed(x, y, ring) for ring in p) % 2)]
        assert got[k] == (max(hits)[1] if hits else None), k
    assert sum(v is not None for v in got.values()) > 200
    assert max(rows_of_joins(d._jdf.queryExecution().executedPlan())) < 100 * len(points)


def test_no_side_of_a_map_goes_through_the_driver_by_its_size_in_files(spark, tmp_path):
    """Files of points and objects are far smaller than the rows that joins make of them."""
    for name in ("customer", "part"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    d = __spark_entry__.queries()["map_objects"](spark, str(tmp_path))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 6 and "Broadcast" not in plan
    assert d.where("object is not null").count() > 50


@pytest.mark.parametrize("query, name, table, key", [("src_delimited_splits", "quoted", "documents", "doc_id"), ("src_dbf_ranges", "dbf", "lineitem", "l_orderkey")])
def test_files_are_written_by_the_tasks_that_read(spark, tmp_path, query, name, table, key):
    given = spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet")
    given.repartition(4, key).write.parquet(str(tmp_path / f"{table}.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    old = set(shared.glob(f"{name}-*"))
    found = __spark_entry__.queries()[query](spark, str(tmp_path))
    (folder,) = set(shared.glob(f"{name}-*")) - old
    assert len([f for f in folder.iterdir() if f.suffix in (".csv", ".dbf")]) >= 4
    want = __spark_entry__.queries()[query](spark, "/root/testdata/sf0.001")
    assert found.count() == want.count() > 0 and found.exceptAll(want).isEmpty()


def test_small_ranges_share_tasks(spark):
    files = spark.createDataFrame([("a", 3 << 30)], "path string, length long")
    assert ranges.tasks(files, 1 << 18) < 200 and ranges.tasks(files, 1 << 30) == 3


def test_a_task_holds_a_bounded_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dbf, "FILE_BYTES", 430)
    rows = [(k, None if k % 7 == 0 else k / 8 - 3, None if k % 5 == 0 else f"é{k}") for k in range(300)]
    d = spark.createDataFrame(rows, "id int, v double, name string").coalesce(1)
    made = dbf.write_dbf_files(d, str(tmp_path / "x"), {"id": 5, "v": 9, "name": 6}, {"v": 2}).collect()
    assert len(made) == 15 and {r.records for r in made} == {20}
    back = dbf.read_dbf(spark, str(tmp_path / "x"), range_bytes=200).collect()
    assert sorted((r.id, r.v, r.name) for r in back) == [(k, None if v is None else float(f"{v:.2f}"), n) for k, v, n in rows]
    with pytest.raises(Exception, match="needs more than 2 characters"):
        dbf.write_dbf_files(d, str(tmp_path / "y"), {"id": 2, "v": 9, "name": 6}, {"v": 2})
