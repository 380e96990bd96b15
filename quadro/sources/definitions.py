"""Small definition files, read on the driver: code tables (CNV), menus of a tabulation
(DEF), saved tables (TAB), maps (binary, GeoJSON), recipes and portable tables (JSON)."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadro.functions.coerce import as_key, encode_1252, kind_of
from quadro.plans.spec import Category, CodeRange, Conversion, Dimension, Filter, Measure, PlanError


def _lines(text: str) -> list[str]:
    return re.split(r"\r\n|\n|\r", text.split("\x1a")[0].lstrip("﻿"))


# Where the columns of a CNV row begin and end, counted from 0.
CLASSIC = {"subtotal": (0, 3), "sequence": (3, 7), "label": (9, 59), "codes": (60, None)}
WIDE = {"subtotal": (0, 4), "sequence": (5, 9), "label": (11, 111), "codes": (112, None)}
HEADER = re.compile(r"^(N?)\s*(\d+)\s+(\d+)(?:\s+(\S+))?\s*$", re.IGNORECASE)


def parse_cnv(text: str, name: str = "cnv") -> Conversion:
    """A code table. The last of several matching rules wins, the first in literal tables
    (marked L, or codes of over four characters); F or FAIXAS marks upper limits."""
    rows = [(k + 1, x.rstrip()) for k, x in enumerate(_lines(text)) if x.strip() and not x.startswith(";")]
    if not rows or not (m := HEADER.match(rows[0][1])):
        raise PlanError(f"{name}: no header of category count and code length")
    wide, count, length, mark = bool(m[1]), int(m[2]), int(m[3]), (m[4] or "").upper()
    if not count or not length:
        raise PlanError(f"{name}: counts must be positive")
    at = WIDE if wide else CLASSIC
    banded = not wide and mark in ("F", "FAIXAS")
    first_wins = not wide and not banded and (mark == "L" or length > 4)
    categories: dict[int, Category] = {}
    rules: list[CodeRange] = []
    bands: list[tuple[int, float]] = []
    for line, row in rows[1:]:
        part = {k: row[a:z].strip() for k, (a, z) in at.items()}
        if not part["sequence"].isdigit() or not int(part["sequence"]):
            raise PlanError(f"{name}, line {line}: no category number")
        sequence, mark = int(part["sequence"]), part["subtotal"]
        if mark and mark != "#" and not mark.isdigit():
            raise PlanError(f"{name}, line {line}: subtotal {mark!r}")
        parent = int(mark) if mark.isdigit() and int(mark) else None
        known = categories.get(sequence)
        if known is None or not known.label:
            categories[sequence] = Category(sequence, part["label"], parent, mark != "#")
        if banded:
            try:
                bands.append((sequence, float(part["codes"])))
            except ValueError as e:
                raise PlanError(f"{name}, line {line}: no upper limit") from e
            continue
        for token in filter(None, (t.strip() for t in part["codes"].split(","))):
            low, dash, high = token.partition("-")
            ranged = bool(low and dash and high)
            rules.append(CodeRange(sequence, low.strip() if ranged else token, high.strip() if ranged else token))
    ordered = tuple(categories[k] for k in sorted(categories))
    return Conversion(name, ordered, tuple(rules), tuple(bands), "first" if first_wins else "last", length)


def write_cnv(c: Conversion) -> str:
    """The classic layout; what its columns can't hold is an error."""
    by: dict[int, list[str]] = {x.sequence: [] for x in c.categories}
    for r in c.rules:
        by[r.sequence].append(r.low if r.low == r.high else f"{r.low}-{r.high}")
    limits = dict(c.bands)
    mark = " F" if c.bands else " L" if c.precedence == "first" and c.code_length <= 4 else ""
    out = [f"{len(c.categories)} {c.code_length}{mark}"]
    for x in c.categories:
        subtotal = str(x.parent) if x.parent else "" if x.totalled else "#"
        if len(subtotal) > 3 or len(str(x.sequence)) > 4 or len(x.label) > 50:
            raise PlanError(f"category {x.sequence} doesn't fit the columns")
        codes = f"{limits[x.sequence]:g}" if c.bands else ",".join(by[x.sequence])
        out.append(f"{subtotal:>3}{x.sequence:>4}  {x.label:<50} {codes}")
    return "\r\n".join(out) + "\r\n"


def cnv_bytes(c: Conversion) -> bytes:
    """The file: Windows-1252, refusing labels that it can't hold."""
    return encode_1252(write_cnv(c))


# What each option line of a DEF file offers its field for.
ROLES = {"S": ("filter",), "L": ("row",), "C": ("column",), "Q": ("section",), "D": ("row", "section"), "T": ("row", "column", "section")}


@dataclass
class Option:
    roles: tuple[str, ...]
    label: str
    field: str
    start: int = 1
    conversion: str | None = None


@dataclass
class Menu:
    sources: list[str] = field(default_factory=list)
    options: list[Option] = field(default_factory=list)
    increments: list[tuple[str, str]] = field(default_factory=list)
    weight: str | None = None
    report: str | None = None
    comments: list[str] = field(default_factory=list)
    unknown: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def measures(self) -> list[Measure]:
        """A count (weighted where the menu says so) and the sums it offers."""
        first = Measure("weighted", self.weight) if self.weight else Measure()
        return [first, *(Measure("sum", f, label) for label, f in self.increments)]

    def dimension(self, label: str, conversions: dict[str, Conversion]) -> Dimension:
        o = next((o for o in self.options if o.label == label), None)
        if o is None:
            raise PlanError(f"no option {label}")
        name = (o.conversion or "").lower()
        if name.endswith(".dbf"):
            return Dimension(o.field, lookup=o.conversion)
        if o.conversion and o.conversion not in conversions:
            raise PlanError(f"no conversion {o.conversion}")
        return Dimension(o.field, conversions.get(o.conversion or ""), o.start)

    def filter(self, label: str, conversions: dict[str, Conversion], accepted: Iterable[str | int]) -> Filter:
        """A choice of an option's categories. A lookup has codes, not categories, so it is no filter."""
        d = self.dimension(label, conversions)
        if d.lookup or d.conversion is None:
            raise PlanError(f"option {label} uses {'the table ' + d.lookup if d.lookup else 'no conversion'}: it can't be a filter")
        return Filter(d.field, categories=tuple(map(str, accepted)), conversion=d.conversion, start=d.start)


def lookup_table(records: DataFrame, key: str, label: str) -> DataFrame:
    """key, label of a lookup's records, once each, trimmed; blank keys are left out, blank labels are
    empty. No usable row, and two labels for one key, raise."""
    text = lambda c: F.trim(F.coalesce(as_key(F.col(c), kind_of(records, c)), F.lit("")))
    d = records.select(text(key).alias("key"), text(label).alias("label")).where("key <> ''").groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
    d = d.withColumn("label", F.when(F.col("label") == F.col("_other"), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("conflicting labels for the key "), F.col("key"))).cast("string"))).drop("_other")
    if d.isEmpty():
        raise PlanError(f"no usable rows of {key} and {label}")
    return d


def parse_def(text: str) -> Menu:
    menu = Menu()
    for k, raw in enumerate(_lines(text)):
        if not raw.strip():
            continue
        kind, rest = raw[0].upper(), raw[1:].strip()
        parts = [p.strip() for p in rest.split(",")]
        if raw[0] == ";" or raw[0].isspace():
            menu.comments.append(raw.lstrip(";").strip())
        elif kind == "A":
            menu.sources.append(parts[0])
        elif kind in ROLES:
            if len(parts) < 2 or not parts[0] or not parts[1]:
                raise PlanError(f"line {k + 1}: an option needs a label and a field")
            start = int(parts[2]) if len(parts) > 2 and parts[2].isdigit() else 1
            menu.options.append(Option(ROLES[kind], parts[0], parts[1], start, parts[3] if len(parts) > 3 and parts[3] else None))
        elif kind == "I":
            if len(parts) < 2 or not parts[1]:
                raise PlanError(f"line {k + 1}: a sum needs a label and a field")
            menu.increments.append((parts[0], parts[1]))
        elif kind == "G" and menu.weight is None:
            menu.weight = rest
        elif kind == "R" and menu.report is None:
            menu.report = rest
        else:
            (menu.warnings if kind in "GR" else menu.unknown).append(raw)
    return menu


def parse_tab(text: str) -> tuple[dict[str, dict[str, str]], list[tuple[str, str, float | None]]]:
    """(settings by section, cells as row, column, value) of a saved table; rows and columns
    labelled Total are left out."""
    sections: dict[str, dict[str, str]] = {"": {}}
    current, grid = "", []
    for line in filter(None, (x.strip() for x in _lines(text))):
        if grid or line.count(";") >= 1 and "=" not in line:
            grid.append([c.strip().strip('"') for c in line.split(";")])
        elif m := re.fullmatch(r"\[(.+)\]", line):
            current = m[1]
            sections[current] = {}
        elif "=" in line:
            key, _, value = line.partition("=")
            sections[current][key.strip()] = value.strip()
    cells = []
    for row in grid[1:]:
        for head, cell in zip(grid[0][1:], row[1:], strict=False):
            if "Total" not in (head, row[0]):
                number = cell.replace(".", "").replace(",", ".")
                cells.append((row[0], head, float(number) if re.fullmatch(r"-?\d+(\.\d+)?", number) else None))
    return sections, cells


RING = "array<struct<x: double, y: double>>"
#: type: polygon, polygon-with-seat, line or point; ring: the outline, of several the longest; parts: all rings, holes too.
MAP_SCHEMA = f"geocode string, name string, x double, y double, ring {RING}, parts array<{RING}>, type string"
# An object's type by its code, and the bytes of its fields.
MAP_TYPES = ("polygon", "polygon-with-seat", "line", "point")
CODE_BYTES, NAME_BYTES, OBJECT_BYTES, MOST_OBJECTS = 10, 25, 48, 100_000


def map_parts(points: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """The rings of an object: one ends where it comes back to its first point."""
    parts, now = [], []
    for p in points:
        now.append(p)
        if len(now) > 2 and p == now[0]:
            parts.append(now)
            now = []
    return [*parts, now] if now else parts


def parse_map(spark: SparkSession, data: bytes) -> DataFrame:
    """The objects of a binary map, version 100: geocode, name, label point, rings, type."""
    if len(data) < 18 or struct.unpack_from("<H", data)[0] != 100:
        raise PlanError("no map of version 100")
    rows, at = [], 18

    def need(n: int, what: str) -> None:
        if at + n > len(data):
            raise PlanError(f"the map ends within {what} of object {len(rows) + 1}")

    while at < len(data):
        if len(rows) == MOST_OBJECTS:
            raise PlanError(f"more than {MOST_OBJECTS} objects")
        need(OBJECT_BYTES, "the head")
        kind, code_size, name_size = data[at], data[at + 1], data[at + 12]
        if kind >= len(MAP_TYPES) or code_size > CODE_BYTES or name_size > NAME_BYTES:
            raise PlanError(f"object {len(rows) + 1}: type {kind}, {code_size} letters of code, {name_size} of name")
        x, y, n = struct.unpack_from("<ffH", data, at + 38)
        need(OBJECT_BYTES + 8 * n, "the points")
        points = [struct.unpack_from("<ff", data, at + OBJECT_BYTES + 8 * k) for k in range(n)]
        if MAP_TYPES[kind].startswith("polygon") and n < 3:
            raise PlanError(f"object {len(rows) + 1}: a polygon of {n} points")
        parts = [[(x, y)]] if MAP_TYPES[kind] == "point" else map_parts(points)
        rows.append((data[at + 2 : at + 2 + code_size].decode("cp1252"), data[at + 13 : at + 13 + name_size].decode("cp1252"), x, y, max(parts, key=len, default=[]), parts, MAP_TYPES[kind]))
        at += OBJECT_BYTES + 8 * n
    return spark.createDataFrame(rows, MAP_SCHEMA)


def read_geojson(spark: SparkSession, text: str, code: str, name: str) -> tuple[DataFrame, list[str]]:
    """(objects as parse_map gives them, warnings): polygons with all their parts and holes, lines, points."""
    rows, warnings = [], []
    for k, f in enumerate(json.loads(text)["features"]):
        kind, at = f["geometry"]["type"], f["geometry"]["coordinates"]
        if kind not in ("Polygon", "MultiPolygon", "LineString", "Point"):
            raise PlanError(f"feature {k + 1}: {kind}")
        rings = {"Polygon": lambda: at, "MultiPolygon": lambda: [r for part in at for r in part], "LineString": lambda: [at], "Point": lambda: [[at]]}[kind]()  # noqa: B023
        outer = [part[0] for part in at] if kind == "MultiPolygon" else rings[:1]
        own = f.get("properties") or {}
        if not own.get(code):
            warnings.append(f"feature {k + 1} has no {code}: left out")
            continue
        parts = [[(float(p[0]), float(p[1])) for p in r] for r in rings]
        ring = [(float(p[0]), float(p[1])) for p in max(outer, key=len)]
        distinct = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
        rows.append((str(own[code]), str(own.get(name) or ""), sum(p[0] for p in distinct) / len(distinct), sum(p[1] for p in distinct) / len(distinct), ring, parts, {"LineString": "line", "Point": "point"}.get(kind, "polygon")))
    return spark.createDataFrame(rows, MAP_SCHEMA), warnings


def read_portable(spark: SparkSession, text: str) -> DataFrame:
    """A table saved by sinks.portable_json: long cells."""
    d = json.loads(text)
    if d.get("version") != 1 or "cells" not in d:
        raise PlanError("no portable table")
    return spark.createDataFrame([(c["row_key"], c["row_label"], c["col_key"], c["col_label"], float(c["value"])) for c in d["cells"]], "row_key string, row_label string, col_key string, col_label string, value double")
