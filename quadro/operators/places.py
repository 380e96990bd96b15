"""Places: which fields name them, what to choose from, and maps joined to results."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadro.functions.coerce import as_key, fold_label, kind_of, state_of, to_number, trim_all
from quadro.operators.ordered import written
from quadro.operators.profiling import inside_parts
from quadro.operators.statistics import exact_quantiles
from quadro.plans.spec import Filter, PlanError

# Names of fields that hold a place, the likeliest first; a municipality's
# code has its state's, so municipalities come before states.
PLACE_FIELDS = (
    ("municipality", "residence", ("CODMUNRES", "MUNIC_RES", "ID_MN_RESI", "MUNIC_RESID")),
    ("municipality", "birth", ("CODMUNNASC",)),
    ("municipality", "occurrence", ("CODMUNOCOR", "MUNIC_MOV", "ID_MUNICIP", "MUNIC_OCOR")),
    ("municipality", "any", ("CODUFMUN", "CODMUN", "MUNICIPIO", "MUNIC")),
    ("state", "residence", ("UFRES", "SG_UF_RES", "UF_RESID")),
    ("state", "any", ("UF", "UF_ZI", "SG_UF", "SG_UF_NOT", "CODUF", "ESTADO")),
)


def place_fields(columns: Sequence[str]) -> list[tuple[str, str, str]]:
    """(field, level, meaning) of fields that look like places, whatever their case."""
    return [(c.strip(), level, meaning) for level, meaning, names in PLACE_FIELDS for c in dict.fromkeys(columns) if c.strip().upper() in names]


# --- choosing places --------------------------------------------------------------------


def place_tree(df: DataFrame, name: str, municipalities: DataFrame, states: DataFrame) -> DataFrame:
    """state, state_name, sign, code, place, records, state_records, known.

    municipalities: code, name; states: code, name, sign. A row for each code that occurs in
    the field; codes without a plausible state or a name stay as rows that aren't known, and
    records without a code as one such row with code null. States without a name are called
    by their code.
    """
    counts = df.groupBy(F.col(name).alias("_v")).agg(F.count(F.lit(1)).alias("records"))
    counts = counts.groupBy(F.nullif(trim_all(as_key(F.col("_v"), kind_of(df, name))), F.lit("")).alias("code")).agg(F.sum("records").alias("records"))
    named = municipalities.groupBy(trim_all(F.col("code").cast("string")).alias("code")).agg(F.min("name").alias("place"))
    d = counts.join(named, "code", "left").withColumn("known", state_of(F.col("code")).isNotNull() & F.coalesce(F.col("place") != "", F.lit(False)))
    d = d.withColumn("state", F.when(F.col("known"), state_of(F.col("code")))).withColumn("place", F.when(F.col("known"), F.col("place")))
    s = states.groupBy(trim_all(F.col("code").cast("string")).alias("state")).agg(F.min_by("name", "sign").alias("_name"), F.min("sign").alias("_sign"))
    d = d.join(d.where("known").groupBy("state").agg(F.sum("records").alias("state_records")), "state", "left").join(s, "state", "left")
    return d.select(
        "state", F.coalesce("_name", F.concat(F.lit("UF "), "state")).alias("state_name"), F.coalesce("_sign", "state").alias("sign"), "code", "place", "records", "state_records",
        F.coalesce("known", F.lit(False)).alias("known"))


def ordered_places(tree: DataFrame) -> DataFrame:
    """States and their municipalities by name, without accents and case; unknown codes last."""
    return tree.orderBy(F.desc("known"), fold_label(F.col("state_name")), "state", fold_label(F.col("place")), "code")


def search_places(tree: DataFrame, text: str) -> DataFrame:
    """What a text finds: whole states by name or sign, else municipalities by name."""
    wanted = fold_label(F.lit(text))
    found = fold_label(F.col("state_name")).contains(wanted) | (fold_label(F.col("sign")) == wanted) | fold_label(F.col("place")).contains(wanted)
    return tree.where((wanted == "") | F.col("known") & found)


def codes_of(tree: DataFrame, states: Sequence[str], municipalities: Sequence[str] = ()) -> list[str]:
    """The codes that a choice of whole states and single municipalities accepts, in order: of
    a state those that occur (a country has some thousand municipalities at most)."""
    found = tree.where(F.col("known") & F.col("state").isin(*states)).select("code").collect() if states else []
    return sorted({r["code"] for r in found} | {m.strip() for m in municipalities if m.strip()})


def selection_filter(field: str, geocodes: Iterable[str]) -> Filter:
    """A choice on a map as a filter on the field that holds the map's codes."""
    codes = tuple(dict.fromkeys(g.strip() for g in geocodes if g.strip()))
    if not field.strip() or not codes:
        raise PlanError("a choice on a map needs a field and one code at least")
    return Filter(field.strip(), categories=codes)


# --- maps -------------------------------------------------------------------------------


def on_map(objects: DataFrame, cells: DataFrame) -> DataFrame:
    """The objects of a map with `value`: a result's by geocode, else by name; null where neither
    fits. cells: row_key, row_label, value (one column of a result). Names are compared
    without accents, case and outer spaces; of rows that share a name the smallest key counts."""
    key, name = F.lower(trim_all(F.col("row_key"))), fold_label(F.col("row_label"))
    by_key = cells.groupBy(key.alias("_k")).agg(F.min_by("value", "row_key").alias("_by_key"), F.lit(True).alias("_has"))
    by_name = cells.groupBy(name.alias("_n")).agg(F.min_by("value", "row_key").alias("_by_name"))
    d = objects.withColumn("_g", F.lower(trim_all(F.col("geocode")))).withColumn("_m", fold_label(F.col("name")))
    d = d.join(by_key, F.col("_g") == F.col("_k"), "left").join(by_name, F.col("_m") == F.col("_n"), "left")
    return d.select(*objects.columns, F.when(F.col("_has"), F.col("_by_key")).otherwise(F.col("_by_name")).alias("value"))


#: Sides of cells are 2**FINE times smaller than an object; pairs of sides that points are looked up in, at most.
FINE, MOST_SIZES = 2, 64


def objects_at(points: DataFrame, objects: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """points with `object`: the key of the last object on the map that is at each, or null.

    objects: ord, key, type, parts (rings, arrays of x and y; islands add, holes take away). A
    polygon (with a seat or without) holds what an odd number of its rings surround, a `point` object (the first point of
    its first ring) the very same coordinates, a `line` nothing. Of several the largest ord wins,
    of equal ones the largest key. Points without finite coordinates are at none; a polygon with
    such a coordinate holds nothing.

    Grids index the polygons: each has cells whose sides are a quarter of the powers of two next
    above its width and its height, so it touches 25 at most, whatever its size. In a cell that
    polygons cover in full only the last of these counts and what comes after it, so a cell keeps
    few polygons however many lie on each other. Points are looked up in the cells of each pair of
    sides in use (MOST_SIZES at most: else sides are powers of 4, 16, ...) by an equi-join, and only
    those in an object's box are tested against its rings. Equal coordinates and equal shapes are
    tested once. No side is broadcast by its size in files: they pack points and cells to a few bytes,
    and one place gives a row for each pair of sides, so what looks small may not fit the driver.
    """
    first = F.col("parts")[0][0]
    known = objects.where(F.size(F.flatten("parts")) > 0).select(F.struct("ord", "key").alias("top"), "type", "parts")
    seats = known.where("type = 'point'").select(first["x"].alias("_x"), first["y"].alias("_y"), "top")
    boxed = written(_boxed(known), "objects")
    sizes = [tuple(r) for r in boxed.select("lx", "ly").distinct().collect()]
    grain = 1
    while len({(-(-a // grain), -(-b // grain)) for a, b in sizes}) > MOST_SIZES:
        grain *= 2
    sizes = sorted({(-(-a // grain) * grain, -(-b // grain) * grain) for a, b in sizes})
    boxed = boxed.withColumns({c: (F.ceil(F.col(c) / grain) * grain).cast("int") for c in ("lx", "ly")})
    cell = ["lx", "ly", "cx", "cy"]
    held = written(_cells(boxed), "cells")
    covered = held.where("full").groupBy(*cell).agg(F.max("top").alias("cover"))
    crossing = held.where("not full").join(covered.hint("merge"), cell, "left").where(F.col("cover").isNull() | (F.col("top") > F.col("cover"))).select(*cell, "_no")
    crossing = crossing.join(boxed.drop("lx", "ly").hint("merge"), "_no")
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    finite = (F.abs(px) < math.inf) & (F.abs(py) < math.inf)
    places = points.where(finite).select(px.alias("_x"), py.alias("_y")).distinct()
    pairs = F.array(*[F.struct(F.lit(a).alias("lx"), F.lit(b).alias("ly")) for a, b in sizes]).cast("array<struct<lx int, ly int>>")
    sought = places.withColumn("s", F.explode(pairs)).select("_x", "_y", "s.lx", "s.ly").withColumn("cx", _cell("_x", "lx")).withColumn("cy", _cell("_y", "ly"))
    met = sought.join(crossing.hint("merge"), cell).where(F.col("_x").between(F.col("x0"), F.col("x1")) & F.col("_y").between(F.col("y0"), F.col("y1")))
    at = ["_x", "_y", "top"]
    found = met.where(inside_parts(F.col("_x"), F.col("_y"), F.col("parts"))).select(*at)
    found = found.union(sought.join(covered.hint("merge"), cell).select("_x", "_y", "cover")).union(places.join(seats.hint("merge"), ["_x", "_y"]).select(*at))
    found = found.groupBy("_x", "_y").agg(F.max("top")["key"].alias("object"))
    return points.join(found, (px == F.col("_x")) & (py == F.col("_y")), "left").select(*[F.col(f"`{c}`") for c in points.columns], "object")


def _cell(v: str, level: str) -> Column:
    """The number of the cell that a coordinate is in; exact, as sides are powers of two."""
    return F.floor(F.col(v) / F.pow(F.lit(2.0), F.col(level) - FINE) + 0.0)


def _boxed(known: DataFrame) -> DataFrame:
    """_no, top, parts, x0, x1, y0, y1, lx, ly: a row for each shape of polygons that can hold a
    point, of equal ones the last; the exponents of powers of two next above its width and height."""
    ends = {c + k: f(F.flatten("parts").getField(c)) for c in "xy" for k, f in (("0", F.array_min), ("1", F.array_max))}
    parts = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: Spark would make one task of them
    d = known.where(F.col("type").isin("polygon", "polygon-with-seat")).repartition(parts, F.xxhash64("top"))
    # by a digest: nested arrays as a key would be made anew for each comparison, and the filters below run on every record
    d = d.withColumn("_shape", F.sha2(F.col("parts").cast("string"), 256)).groupBy("_shape").agg(F.max("top").alias("top"), F.first("parts").alias("parts")).drop("_shape").withColumns(ends)
    d = d.where((F.col("x0") > -math.inf) & (F.col("x1") < math.inf) & (F.col("y0") > -math.inf) & (F.col("y1") < math.inf) & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    for c in "xy":
        low, high = F.col(c + "0"), F.col(c + "1")
        # never so fine beside the coordinates that numbers of cells aren't exact
        extent = F.greatest(high - low, F.greatest(F.abs(low), F.abs(high)) * 2.0**-48, F.lit(2.0**-500))
        level = F.ceil(F.log2(extent)).cast("int")
        d = d.withColumn("l" + c, F.when(F.pow(F.lit(2.0), level) < extent, level + 1).otherwise(level))
    return d.repartition(parts).withColumn("_no", F.monotonically_increasing_id())


def _cells(boxed: DataFrame) -> DataFrame:
    """lx, ly, cx, cy, _no, top, full: the cells that each polygon's box touches, and whether it holds
    every point of the cell. It does if no edge comes near the cell and its middle is inside."""
    d = boxed
    for c in "xy":
        d = d.withColumn("c" + c, F.explode(F.sequence(_cell(c + "0", "l" + c), _cell(c + "1", "l" + c))))
        side = F.pow(F.lit(2.0), F.col("l" + c) - FINE)
        d = d.withColumns({c + "a": F.col("c" + c) * side, c + "z": (F.col("c" + c) + 1) * side})
    xa, xz, ya, yz = (F.col(c) for c in ("xa", "xz", "ya", "yz"))

    def near(p: Column, q: Column) -> Column:
        """Whether an edge may touch a cell; what rounding could turn counts as touching."""
        small = 2.0**-40
        fx, fy = (F.abs(p["x"]) + F.abs(q["x"])) * small, (F.abs(p["y"]) + F.abs(q["y"])) * small
        apart = (F.least(p["x"], q["x"]) > xz + fx) | (F.greatest(p["x"], q["x"]) < xa - fx) | (F.least(p["y"], q["y"]) > yz + fy) | (F.greatest(p["y"], q["y"]) < ya - fy)
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        turns = [dx * (b - p["y"]) - dy * (a - p["x"]) for a in (xa, xz) for b in (ya, yz)]
        error = (F.abs(dx) * (F.abs(p["y"]) + F.abs(ya) + F.abs(yz)) + F.abs(dy) * (F.abs(p["x"]) + F.abs(xa) + F.abs(xz))) * small
        return ~apart & (F.least(*turns) <= error) & (F.greatest(*turns) >= -error)

    def touched(ring: Column) -> Column:
        n = F.size(ring)
        return F.exists(F.transform(ring, lambda p, i: near(p, F.get(ring, (i + n - 1) % n))), lambda b: b)

    within = (xa > F.col("x0")) & (xz < F.col("x1")) & (ya > F.col("y0")) & (yz < F.col("y1"))
    full = F.when(within, ~F.exists("parts", touched) & inside_parts((xa + xz) / 2, (ya + yz) / 2, F.col("parts"))).otherwise(False)
    return d.select("lx", "ly", "cx", "cy", "_no", "top", full.alias("full"))


def class_limits(df: DataFrame, name: str, kind: str, classes: int = 5, breaks: Sequence[float] = ()) -> list[float]:
    """The limits of a map's classes, lowest first: quantile, equal, continuous (as equal), or
    manual (`breaks` inside the observed range, increasing). Empty: no number."""
    v = to_number(F.col(name), kind_of(df, name))
    finite = F.when(F.abs(v) < math.inf, v)
    if kind == "quantile":
        found = exact_quantiles(df, finite, [k / _number(classes) for k in range(_number(classes) + 1)])
        return [] if found[0] is None else found
    low, high = df.agg(F.min(finite), F.max(finite)).first()
    if low is None:
        return []
    if kind == "manual":
        inner = [float(b) for b in breaks]
        if not inner or any(not low < b < high for b in inner) or any(a >= b for a, b in zip(inner, inner[1:], strict=False)):
            raise PlanError(f"breaks must increase within {low:g} and {high:g}")
        return [low, *inner, high]
    if kind not in ("equal", "continuous"):
        raise PlanError(f"classes {kind}")
    return [low + (high - low) * k / _number(classes) for k in range(_number(classes) + 1)]


def _number(classes: int) -> int:
    return min(9, max(2, round(classes)))


def class_of(value: Column, limits: Sequence[float]) -> Column:
    """The class of a value, from 0: the first whose upper limit isn't below; the last for all above."""
    found = F.lit(max(0, len(limits) - 2))
    for k in reversed(range(len(limits) - 2)):
        found = F.when(value <= limits[k + 1], F.lit(k)).otherwise(found)
    return F.when(F.abs(value) < math.inf, found)


def shade_of(value: Column, limits: Sequence[float]) -> Column:
    """0 to 1 along a continuous ramp, by the square root of a value's place in the range."""
    if not limits:
        return F.lit(None).cast("double")
    low, high = limits[0], limits[-1]
    place = F.lit(1.0) if low == high else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low) / (high - low)))
    return F.when(F.abs(value) < math.inf, F.sqrt(place))
