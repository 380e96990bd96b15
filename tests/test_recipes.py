"""Recipes, generated code, archives."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quadro.operators import transform as tr
from quadro.plans import recipe
from quadro.plans.spec import Category, CodeRange, Conversion, Dimension, Filter, Measure, PlanError, Rule, TabulationSpec
from quadro.sources import archives

SEX = Conversion("sex", (Category(1, "M"), Category(2, "F", 1)), (CodeRange(1, "1", "1"),), ((1, 2.5),))
SPEC = TabulationSpec(Dimension("a", SEX), Dimension("b"), (Measure("sum", "v"),), (Filter("v", low=1.0, high=2.5),), (Rule("r", (Filter("a", categories=("1",)), Filter("b", low=0.0))),), suppress_rows=True)


def test_recipes_round_trip():
    text = recipe.save(SPEC, [("rename", {"old": "x", "new": "y"})])
    spec, operations = recipe.load(text)
    assert spec == SPEC
    assert operations == [("rename", {"old": "x", "new": "y"})]
    assert recipe.save(spec, operations) == text


@pytest.mark.parametrize("text", ["nope", '{"version": 2}', '{"version": 1, "spec": {"rows": {"field": 3}}}', '{"version": 1, "spec": {"rows": {"field": "a", "what": 1}}}', '{"version": 1, "spec": {}}'])
def test_bad_recipes_are_refused(text):
    with pytest.raises(PlanError):
        recipe.load(text)


def test_generated_code_builds_the_same_pipeline(spark):
    d = spark.range(10).select(F.col("id").cast("string").alias("a"))
    steps = [tr.Step("x", tr.Recode("a", {"1": "one"}, "b", "null")), tr.Step("y", tr.Dedupe(["b"], ["a"]))]
    names = {"tr": tr, "df": d}
    exec(tr.to_code(steps), names)  # noqa: S102
    assert sorted(map(str, names["df"].collect())) == sorted(map(str, tr.run(d, steps).collect()))


def test_right_join_of_many_to_many_is_refused(spark):
    left = spark.createDataFrame([("1", "a"), ("1", "b")], "k string, x string")
    right = spark.createDataFrame([("1", 1), ("1", 2)], "k string, y int")
    with pytest.raises(Exception, match="both sides"):
        tr.Join(right, [("k", "k")], "right").apply(left).collect()


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def test_archives(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(zipped({"x.txt": b"1", "in.zip": zipped({"y.txt": b"2"})}))
    rows = archives.read_zips(spark, str(tmp_path)).collect()
    assert sorted((r.path, bytes(r.content)) for r in rows) == [("x.txt", b"1"), ("y.txt", b"2")]


def test_old_worksheets():
    label = struct.pack("<HHHH", 0, 1, 0, 3) + b"Ac\xe9"
    data = struct.pack("<HH", 0x0204, len(label)) + label + struct.pack("<HH", 0x0203, 14) + struct.pack("<HHHd", 2, 3, 0, 1.5) + struct.pack("<HH", 10, 0)
    assert archives.parse_biff(data) == {(0, 1): "Acé", (2, 3): 1.5}
