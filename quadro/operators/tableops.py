"""Operations on result tables: wide DataFrames of row_key, row_label, ord and numbers.

`ord` is the row's place; operations that look at neighbours use it. Every operation
gives a new table. A result that isn't finite raises with the row's label.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadro.functions.coerce import fold_label, natural_key
from quadro.functions.formula import formula
from quadro.plans.spec import PlanError

AXIS = ("row_key", "row_label", "ord")


def values_of(t: DataFrame) -> list[str]:
    return [c for c in t.columns if c not in AXIS]


def _order() -> Window:
    # One row for each row of a result table, which is presented whole.
    return Window.orderBy("ord")


def _need(t: DataFrame, *names: str) -> None:
    if absent := [n for n in names if n not in values_of(t)]:
        raise PlanError(f"no column {', '.join(absent)}")


def _added(t: DataFrame, name: str, value: Column) -> DataFrame:
    if name in t.columns:
        raise PlanError(f"column {name} exists")
    good = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    why = F.raise_error(F.concat(F.lit(f"{name}: no finite result in "), F.coalesce("row_label", F.lit("?")))).cast("double")
    return t.withColumn(name, F.when(good, value).otherwise(why))


def _cell(name: str) -> Column:
    """A cell; an absent one counts as 0."""
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def binary(t: DataFrame, name: str, kind: str, left: str, right: str, division: str = "error") -> DataFrame:
    """add, subtract, multiply, divide, minimum, maximum, percentage of two columns."""
    _need(t, left, right)
    a, b = _cell(left), _cell(right)
    ratio = F.try_divide(a, b)
    if division == "zero":
        ratio = F.when(b == 0, 0.0).otherwise(ratio)
    made = {"add": a + b, "subtract": a - b, "multiply": a * b, "divide": ratio, "minimum": F.least(a, b), "maximum": F.greatest(a, b), "percentage": ratio * 100}
    return _added(t, name, made[kind].cast("double"))


def unary(t: DataFrame, name: str, kind: str, column: str, factor: float = 1.0) -> DataFrame:
    """factor, cumulative, absolute, truncate, round, floor, ceil of a column."""
    _need(t, column)
    v = _cell(column)
    made = {
        "factor": v * factor, "absolute": F.abs(v), "floor": F.floor(v), "ceil": F.ceil(v), "round": F.floor(v + 0.5), "truncate": F.signum(v) * F.floor(F.abs(v)),
        "cumulative": F.sum(v).over(_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    }
    return _added(t, name, made[kind].cast("double"))


def sequence(t: DataFrame, name: str, start: float = 1.0, step: float = 1.0) -> DataFrame:
    return _added(t, name, F.lit(start) + F.lit(step) * (F.row_number().over(_order()) - 1))


def constant(t: DataFrame, name: str, value: float) -> DataFrame:
    return _added(t, name, F.lit(float(value)))


def expression(t: DataFrame, name: str, text: str, division: str = "error") -> DataFrame:
    """A formula over the columns; absent cells are 0."""
    values = {c: F.col(c) for c in values_of(t)}
    return _added(t, name, formula(text, values, missing="zero", division=division, order=_order(), whole=Window.partitionBy()))


def rename(t: DataFrame, old: str, new: str) -> DataFrame:
    _need(t, old)
    if new in t.columns:
        raise PlanError(f"column {new} exists")
    return t.withColumnRenamed(old, new)


def move(t: DataFrame, column: str, place: int) -> DataFrame:
    _need(t, column)
    rest = [c for c in values_of(t) if c != column]
    if not 0 <= place <= len(rest):
        raise PlanError(f"no place {place}")
    return t.select(*[c for c in AXIS if c in t.columns], *rest[:place], column, *rest[place:])


def delete(t: DataFrame, column: str) -> DataFrame:
    _need(t, column)
    if len(values_of(t)) == 1:
        raise PlanError("a table keeps one column at least")
    return t.drop(column)


def transpose(cells: DataFrame) -> DataFrame:
    """Long cells with rows and columns swapped: names only, no data moves."""
    swap = {"row": "col", "col": "row"}
    return cells.select(*[F.col(c).alias(swap[c[:3]] + c[3:]) if c[:3] in swap else F.col(c) for c in cells.columns])


def include(t: DataFrame, other: DataFrame, columns: Sequence[str], prefix: str = "") -> DataFrame:
    """Columns of another table with exactly the same row keys."""
    _need(other, *columns)
    right = other.select(F.col("row_key").alias("_k"), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    joined = t.join(right, t["row_key"] == right["_k"], "full")
    ok = F.col("row_key").isNotNull() & F.col("_k").isNotNull()
    return joined.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("row on one side only: "), F.coalesce("row_key", "_k"))).cast("boolean"))).drop("_k")


def _checked(t: DataFrame, *tests: tuple[Column, str]) -> DataFrame:
    """t, or the first reason (an aggregate that must hold over its rows, and what to say) why not."""
    found = t.agg(*[F.coalesce(c, F.lit(False)).alias(f"_{k}") for k, (c, _) in enumerate(tests)])
    fault = reduce(lambda rest, k: F.when(F.col(f"_{k}"), rest).otherwise(F.raise_error(F.lit(tests[k][1])).cast("boolean")), reversed(range(len(tests))), F.lit(True))
    return t.join(F.broadcast(found.select(fault.alias("_fine")))).where("_fine").drop("_fine")


def suppress_rows(t: DataFrame, keys: Sequence[str]) -> DataFrame:
    """t without some rows; keys that match none raise, and so does leaving none."""
    chosen = F.coalesce(F.col("row_key").isin(*keys), F.lit(False))
    return _checked(t, (F.bool_or(chosen), "no row to suppress"), (F.bool_or(~chosen), "a table keeps one row at least")).where(~chosen)


def aggregate_rows(t: DataFrame, keys: Sequence[str], key: str, label: str, keep: bool = False) -> DataFrame:
    """The sum of some rows as a new last row; a choice of none, and a key that stays on another row, raise."""
    chosen = F.coalesce(F.col("row_key").isin(*keys), F.lit(False))
    taken = (F.col("row_key") == key) & (F.lit(True) if keep else ~chosen)
    t = _checked(t, (F.bool_or(chosen), "no row to add up"), (~F.bool_or(F.coalesce(taken, F.lit(False))), f"row {key} exists"))
    added = t.where(chosen).agg(*[F.sum(c).alias(c) for c in values_of(t)])
    place = t.agg((F.max("ord") + 1).alias("ord"))
    added = added.join(F.broadcast(place)).select(F.lit(key).alias("row_key"), F.lit(label).alias("row_label"), "ord", *values_of(t))
    return (t if keep else t.where(~chosen)).select("row_key", "row_label", "ord", *values_of(t)).unionByName(added)


OPERATIONS = {"binary": binary, "unary": unary, "sequence": sequence, "constant": constant, "expression": expression, "rename": rename, "move": move, "delete": delete, "suppress": suppress_rows, "aggregate": aggregate_rows}


def replay(t: DataFrame, operations: Sequence[tuple[str, dict]]) -> DataFrame:
    """A recorded list of operations, in order."""
    return reduce(lambda d, o: OPERATIONS[o[0]](d, **o[1]), operations, t)


def presented(t: DataFrame, by: str = "original", descending: bool = False, search: str | None = None) -> DataFrame:
    """Rows whose key or label contains a text, in the order asked for (stable)."""
    if search:
        needle = fold_label(F.lit(search))
        t = t.where(fold_label(F.concat_ws(" ", "row_key", "row_label")).contains(needle))
    if by == "original":
        return t.orderBy("ord")
    key = natural_key(fold_label(F.col("row_label"))) if by == "row_label" else F.col(by)
    return t.orderBy(key.desc() if descending else key.asc(), "ord")


def ranked(t: DataFrame, column: str, count: int) -> DataFrame:
    """The rows with the largest values, for a chart."""
    return t.orderBy(F.desc(column), "row_label").limit(count)


# --- what charts show -------------------------------------------------------------------


def scatter(t: DataFrame, x: str, y: str, size: str | None = None, limit: int = 100) -> DataFrame:
    """row_key, row_label, x, y, size of the first rows; without a size the sum of a row's cells."""
    _need(t, x, y, *([size] if size else []))
    weight = _cell(size) if size else reduce(lambda a, b: a + b, [_cell(c) for c in values_of(t)])
    return t.orderBy("ord").select("row_key", "row_label", _cell(x).alias("x"), _cell(y).alias("y"), weight.alias("size")).limit(limit)


def arrows(t: DataFrame, limit: int) -> DataFrame:
    """row_key, row_label, start, end: the first and last column of the rows that change most."""
    names = values_of(t)
    if len(names) < 2:
        raise PlanError("arrows need two columns")
    first, last = names[0], names[-1]
    d = t.select("row_key", "row_label", _cell(first).alias("start"), _cell(last).alias("end"))
    return d.orderBy(F.desc(F.abs(F.col("end") - F.col("start"))), "row_label").limit(limit)


def series(t: DataFrame) -> DataFrame:
    """series, row_key, row_label, value: a line for each column over the table's rows."""
    lines = F.array(*[F.struct(F.lit(c).alias("series"), _cell(c).alias("value")) for c in values_of(t)])
    return t.select("row_key", "row_label", F.inline(lines)).select("series", "row_key", "row_label", "value")


# --- comparison -------------------------------------------------------------------------


def compare(left: DataFrame, right: DataFrame, column: str, other: str | None = None, how: str = "inner", match: str = "key", mapping: DataFrame | None = None, relative_to: str = "left") -> DataFrame:
    """row_key, row_label, left, right, difference, absolute, relative, ratio.

    match: key, label (without accents and case), or map (a table of left_key, right_key).
    Keys that repeat on a side raise.
    """
    d = _matched(left.select("row_key", "row_label", F.col(column).alias("left")), right.select(F.col("row_key").alias("r_key"), F.col("row_label").alias("r_label"), F.col(other or column).alias("right")), how, match, mapping)
    base = F.col("left" if relative_to == "left" else "right")
    diff = F.col("right") - F.col("left")
    return d.select(
        F.coalesce("row_key", "r_key").alias("row_key"), F.coalesce("row_label", "r_label").alias("row_label"), "left", "right", diff.alias("difference"), F.abs(diff).alias("absolute"),
        F.when(base != 0, diff / base * 100).alias("relative"), F.when(F.col("left") != 0, F.col("right") / F.col("left")).alias("ratio"))


def _matched(a: DataFrame, b: DataFrame, how: str, match: str, mapping: DataFrame | None) -> DataFrame:
    """Rows of a (row_key, row_label, ...) beside those of b (r_key, r_label, ...) that they match."""
    a = a.withColumn("_m", fold_label(F.col("row_label")) if match == "label" else F.col("row_key"))
    b = b.withColumn("_n", fold_label(F.col("r_label")) if match == "label" else F.col("r_key"))
    if match == "map":
        b = b.join(mapping.select(F.col("right_key").alias("_n"), F.col("left_key").alias("_to")), "_n", "left").withColumn("_n", F.coalesce("_to", F.concat(F.lit("\x00"), "_n"))).drop("_to")
    once = lambda d, k: d.groupBy(k).agg(*[F.first(c).alias(c) for c in d.columns if c != k], F.count(F.lit(1)).alias("_c")).where(
        F.when(F.col("_c") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("repeated row: "), F.col(k))).cast("boolean"))).drop("_c")
    return once(a, "_m").join(once(b, "_n"), F.col("_m") == F.col("_n"), how)


def compare_diagnostics(left: DataFrame, right: DataFrame, how: str = "inner", match: str = "key", mapping: DataFrame | None = None, require_labels: bool = False) -> tuple[DataFrame, DataFrame]:
    """(one row: left_rows, right_rows, matched_rows, left_only_rows, right_only_rows, left_coverage,
    right_coverage, label_mismatches, warnings; the matched rows whose labels differ).

    Coverage is the share of a side's rows that match, 0 of an empty side. require_labels: rows
    matched by key whose labels differ raise."""
    a, b = left.select("row_key", "row_label"), right.select(F.col("row_key").alias("r_key"), F.col("row_label").alias("r_label"))
    d = _matched(a, b, how, match, mapping).withColumns({"_a": F.col("_m").isNotNull(), "_b": F.col("_n").isNotNull()})
    both = F.col("_a") & F.col("_b")
    differ = both & ~F.col("row_label").eqNullSafe(F.col("r_label"))
    if require_labels and match == "key":
        why = F.raise_error(F.concat(F.lit("labels differ for the key "), F.col("row_key"))).cast("boolean")
        d = d.where(F.when(differ, why).otherwise(F.lit(True)))
    size = lambda t, name: F.broadcast(t.agg(F.count(F.lit(1)).alias(name)))
    s = d.agg(F.count_if(both).alias("matched_rows"), F.count_if(F.col("_a") & ~F.col("_b")).alias("left_only_rows"), F.count_if(F.col("_b") & ~F.col("_a")).alias("right_only_rows"), F.count_if(differ).alias("label_mismatches"))
    s = s.join(size(left, "left_rows")).join(size(right, "right_rows"))
    share = lambda n: F.coalesce(F.try_divide(F.col("matched_rows"), F.col(n)), F.lit(0.0))
    alone = F.when(F.col("left_only_rows") + F.col("right_only_rows") > 0, F.format_string("%d row(s) on the left only, %d on the right only", "left_only_rows", "right_only_rows"))
    other = F.when(F.col("label_mismatches") > 0, F.format_string("%d matched row(s) have different labels", "label_mismatches"))
    policy = F.lit(None if match == "key" else f"rows were matched by {match}").cast("string")
    counts = s.select(
        "left_rows", "right_rows", "matched_rows", "left_only_rows", "right_only_rows", share("left_rows").alias("left_coverage"), share("right_rows").alias("right_coverage"), "label_mismatches",
        F.array_compact(F.array(alone, other, policy)).alias("warnings"))
    return counts, d.where(differ).select("row_key", F.col("r_key").alias("other_key"), "row_label", F.col("r_label").alias("other_label"))


def compare_summary(compared: DataFrame) -> DataFrame:
    """n, mae, rmse, mape, pearson over rows on both sides."""
    d = compared.where("left is not null and right is not null")
    return d.agg(
        F.count(F.lit(1)).alias("n"), F.avg("absolute").alias("mae"), F.sqrt(F.avg(F.col("difference") * F.col("difference"))).alias("rmse"),
        (F.avg(F.when(F.col("left") != 0, F.abs(F.col("difference") / F.col("left")))) * 100).alias("mape"), F.corr("left", "right").alias("pearson"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """row_key, col_key, status (added, removed, changed, same), before, after of long cells."""
    a = before.select("row_key", "col_key", F.col("value").alias("before"))
    b = after.select("row_key", "col_key", F.col("value").alias("after"))
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return a.join(b, ["row_key", "col_key"], "full").select("row_key", "col_key", status.alias("status"), "before", "after")


def against_golden(cells: DataFrame, golden: DataFrame, tolerance: float = 0.0, decimals: int | None = None) -> DataFrame:
    """row_labels, column_labels, shape, cells (whether each agrees), differing, passed: one row.

    Both are long cells with row_sort and col_sort. Cells at the same place are compared, at
    `decimals` if given; labels must agree in text and order.
    """
    if not 0 <= tolerance < float("inf") or decimals is not None and decimals < 0:
        raise PlanError("tolerance and decimals can't be negative or infinite")

    def placed(d: DataFrame, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        axes = []
        for side in ("row", "col"):
            # Places on an axis of a table that is presented whole: one row for each label.
            axis = d.select(f"{side}_key", f"{side}_label", f"{side}_sort").distinct()
            axes.append(axis.withColumn(side, F.row_number().over(Window.orderBy(f"{side}_sort", f"{side}_key"))))
        rows, cols = axes
        at = d.join(rows.select("row_key", "row"), "row_key").join(cols.select("col_key", "col"), "col_key")
        return rows.select("row", F.col("row_label").alias(value)), cols.select("col", F.col("col_label").alias(value)), at.select("row", "col", F.col("value").alias(value))

    got, want = placed(cells, "a"), placed(golden, "b")
    rounded = lambda c: c if decimals is None else F.floor(c * 10**decimals + 0.5) / 10**decimals
    labels = [x.join(y, x.columns[0], "full").agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias(n)) for x, y, n in zip(got, want, ("row_labels", "column_labels"), strict=False)]
    both = got[2].join(want[2], ["row", "col"], "full")
    one_side = F.col("a").isNull() | F.col("b").isNull()
    found = both.agg(
        (F.count_if(one_side) == 0).alias("shape"), F.count_if(~one_side & (F.abs(rounded(F.col("a")) - rounded(F.col("b"))) > tolerance)).alias("differing"))
    d = labels[0].join(labels[1]).join(found).withColumn("cells", F.col("differing") == 0)
    return d.select("row_labels", "column_labels", "shape", "cells", "differing", (F.col("row_labels") & F.col("column_labels") & F.col("shape") & F.col("cells")).alias("passed"))
