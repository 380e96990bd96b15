"""Fields of places, choices, maps and what charts show."""

import pytest
from pyspark.sql import functions as F

from quadro.operators import places, tableops
from quadro.plans.spec import PlanError


def test_fields_of_places_in_order_of_likelihood():
    got = places.place_fields(["UF", "munic_mov", "IDADE", "ID_MN_RESI", "SG_UF_NOT", "CODMUNNASC"])
    assert [(f, level) for f, level, _ in got] == [("ID_MN_RESI", "municipality"), ("CODMUNNASC", "municipality"), ("munic_mov", "municipality"), ("UF", "state"), ("SG_UF_NOT", "state")]
    assert places.place_fields([]) == []


@pytest.fixture(scope="module")
def tree(spark):
    d = spark.createDataFrame([(c,) for c in ["150140"] * 3 + [" 150080 ", "355030", "999999", "", None, "350000", "520870"]], "code string")
    towns = spark.createDataFrame([("150140", "Belém"), ("150140", "Belém"), ("150080", "Ananindeua"), ("355030", "São Paulo"), ("520870", "Goiânia"), ("999999", "X")], "code string, name string")
    states = spark.createDataFrame([("15", "Pará", "PA"), ("35", "São Paulo", "SP")], "code string, name string, sign string")
    return places.place_tree(d, "code", towns, states)


def test_tree_keeps_unknown_codes(tree):
    rows = {r.code: r for r in tree.collect()}
    assert len(rows) == tree.count() == 7  # no code of its own for blanks: they meet under null
    assert rows["150140"].records == 3 and rows["150140"].state_records == 4 and rows["150140"].sign == "PA"
    assert rows["520870"].state_name == "UF 52"
    assert {c: r.records for c, r in rows.items() if not r.known} == {"999999": 1, "350000": 1, None: 2}
    assert [r.place for r in places.ordered_places(tree).collect()] == ["Ananindeua", "Belém", "São Paulo", "Goiânia", None, None, None]


def test_search_and_choice(tree):
    find = lambda text: sorted(r.code for r in places.search_places(tree, text).where("known").collect())
    assert find("sao paulo") == ["355030"] and find("pa") == ["150080", "150140", "355030"] and find("BELEM") == ["150140"] and find("nada") == []
    assert places.search_places(tree, "").count() == 7
    assert places.codes_of(tree, ["15"], ["520870", " 150140"]) == ["150080", "150140", "520870"]
    assert places.codes_of(tree, []) == []
    assert places.selection_filter(" MUN ", ["1", " 1", ""]).categories == ("1",)
    for field, codes in (("", ["1"]), ("MUN", [" "])):
        with pytest.raises(PlanError):
            places.selection_filter(field, codes)


def test_map_takes_codes_before_names(spark):
    objects = spark.createDataFrame([("A1", "Pará"), ("x", " SAO PAULO"), ("y", "Acre"), (None, None)], "geocode string, name string")
    cells = spark.createDataFrame([("a1", "Acre", 1.0), ("2", "São Paulo", 2.0), ("3", "São Paulo", 3.0), ("4", None, 4.0), ("x9", "Pará", 5.0)], "row_key string, row_label string, value double")
    assert {r.geocode: r.value for r in places.on_map(objects, cells).collect()} == {"A1": 1.0, "x": 2.0, "y": 1.0, None: None}
    assert places.on_map(objects, cells.limit(0)).where("value is null").count() == 4


def test_classes(spark):
    d = spark.createDataFrame([(0.0,), (4.0,), (10.0,), (None,), (float("inf"),)], "v double")
    assert places.class_limits(d, "v", "equal", 2) == [0, 5, 10] and places.class_limits(d, "v", "equal", 40)[1] == pytest.approx(10 / 9)
    limits = places.class_limits(d, "v", "manual", breaks=[4, 6])
    got = d.select("v", places.class_of(F.col("v"), limits).alias("c"), places.shade_of(F.col("v"), limits).alias("s")).collect()
    assert [(r.c, r.s and round(r.s, 6)) for r in got] == [(0, 0.0), (0, 0.632456), (2, 1.0), (None, None), (None, None)]
    for wrong in ([], [0, 5], [5, 5], [6, 5], [5, 10]):
        with pytest.raises(PlanError):
            places.class_limits(d, "v", "manual", breaks=wrong)
    for kind in ("quantile", "equal", "manual"):
        assert places.class_limits(d.limit(0), "v", kind) == []
    assert d.limit(0).select(places.class_of(F.col("v"), []), places.shade_of(F.col("v"), [])).count() == 0
    one = spark.createDataFrame([(3.0,)], "v double")
    assert one.select(places.shade_of(F.col("v"), places.class_limits(one, "v", "continuous"))).first()[0] == 1.0


def test_golden_sees_order_labels_shape_and_cells(spark):
    def cells(rows, values, order=None):
        return spark.createDataFrame([(f"k{r}", r, "0", "Freq", float(v), str((order or rows).index(r)), "0") for r, v in zip(rows, values, strict=True)], "row_key string, row_label string, col_key string, col_label string, value double, row_sort string, col_sort string")

    same = tableops.against_golden(cells("ab", (1, 2)), cells("ab", (1, 2))).first()
    assert same.passed
    flags = lambda a, b, **k: tuple(tableops.against_golden(a, b, **k).first())
    assert flags(cells("ab", (1, 2)), cells("ab", (1, 2), "ba")) == (False, True, True, False, 2, False)
    assert flags(cells("abc", (1, 2, 3)), cells("ab", (1, 2)))[:3] == (False, True, False)
    assert flags(cells("ab", (1, 2.004)), cells("ab", (1, 2)))[4] == 1
    assert flags(cells("ab", (1, 2.004)), cells("ab", (1, 2)), decimals=2)[5]
    with pytest.raises(PlanError):
        tableops.against_golden(same and cells("a", (1,)), cells("a", (1,)), -1)


def test_charts_need_columns_and_take_absent_cells_as_0(spark):
    t = spark.createDataFrame([("1", "b", 0, 1.0, None), ("2", "a", 1, 5.0, 6.0)], "row_key string, row_label string, ord int, x double, y double")
    assert [tuple(r) for r in tableops.arrows(t, 9).collect()] == [("2", "a", 5.0, 6.0), ("1", "b", 1.0, 0.0)]
    assert [tuple(r) for r in tableops.scatter(t, "x", "y", limit=1).collect()] == [("1", "b", 1.0, 0.0, 1.0)]
    assert tableops.series(t).count() == 4
    for wrong in (lambda: tableops.arrows(t.drop("y"), 1), lambda: tableops.scatter(t, "x", "z")):
        with pytest.raises(PlanError):
            wrong()
