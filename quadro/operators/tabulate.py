"""Cross-tabulation: rows by columns by measure, as one aggregation.

The result is long, one row for each cell: row_key, row_label, col_key, col_label, value,
and row_sort and col_sort, texts whose plain order is the order of the axes. Axes of a
conversion or a lookup list every category, zeros included; axes of raw values list what
occurs. Long form has no limit on the number of columns; to_wide() is for presentation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadro.functions.coerce import kind_of, measure_number, natural_key, not_a_number
from quadro.operators.predicates import dimension_key, passing, rule_counts
from quadro.operators.ordered import written as _written
from quadro.plans.spec import UNCLASSIFIED, UNCLASSIFIED_LABEL, Conversion, Dimension, Measure, PlanError, QueryPlan, TabulationSpec, compile_plan

WIDEST = 2000


@dataclass
class Tabulation:
    plan: QueryPlan
    source: DataFrame
    cells: DataFrame
    lookups: dict[str, DataFrame] = field(default_factory=dict)
    counted: DataFrame | None = None

    def counters(self) -> DataFrame:
        """seen, accepted, and values that a sum counted as 0: of a table that was made counted,
        from its own aggregate, else in a pass over the records."""
        if self.counted is not None:
            return self.counted
        spec, d = self.plan.spec, self.source
        sums = [m.field for m in spec.measures if m.field]
        bad = [F.count_if(accepted(d, spec, self.lookups) & not_a_number(F.col(f), kind_of(d, f))).alias(f"not_numbers_{f}") for f in dict.fromkeys(sums)]
        return d.agg(F.count(F.lit(1)).alias("seen"), F.count_if(accepted(d, spec, self.lookups)).alias("accepted"), *bad)

    def data_quality(self) -> DataFrame:
        return rule_counts(self.source, self.plan.spec.rules)

    def ordered(self) -> DataFrame:
        return self.cells.orderBy("row_sort", "col_sort")

    def to_wide(self) -> DataFrame:
        """One row for each row of the table, one column for each of its columns."""
        heads = [r[0] for r in self.cells.select("col_label", "col_sort").distinct().orderBy("col_sort").limit(WIDEST + 1).collect()]
        if len(heads) > WIDEST:
            raise ValueError(f"more than {WIDEST} columns: use the long form")
        wide = self.cells.groupBy("row_sort", "row_key", "row_label").pivot("col_label", heads).agg(F.first("value"))
        return wide.orderBy("row_sort").drop("row_sort")


def _key(d: DataFrame, dim: Dimension, lookups: dict[str, DataFrame]) -> Column:
    key = dimension_key(d, dim)
    if dim.lookup is not None:
        key = F.when(F.col(f"_known_{dim.field}"), key)
    return F.coalesce(key, F.lit(UNCLASSIFIED)) if dim.unclassified == "discriminate" else key


def _dimensions(spec: TabulationSpec) -> list[Dimension]:
    return [spec.rows, *([spec.columns] if spec.columns else [])]


def prepared(df: DataFrame, spec: TabulationSpec, lookups: dict[str, DataFrame]) -> DataFrame:
    """The columns that a plan reads, with lookup keys marked as known."""
    d = df.select(*spec.fields_used())
    for dim in _dimensions(spec):
        if dim.lookup is not None:
            keys = lookups[dim.lookup].select(F.col("key").alias("_k")).distinct().withColumn(f"_known_{dim.field}", F.lit(True))
            d = d.join(keys, dimension_key(d, dim) == F.col("_k"), "left").drop("_k")
    return d


def accepted(d: DataFrame, spec: TabulationSpec, lookups: dict[str, DataFrame]) -> Column:
    keep = passing(d, spec.filters, spec.rules)
    for dim in _dimensions(spec):
        keep = keep & _key(d, dim, lookups).isNotNull()
    return F.coalesce(keep, F.lit(False))


def accepted_records(df: DataFrame, spec: TabulationSpec, lookups: dict[str, DataFrame] | None = None) -> DataFrame:
    """The records that a tabulation counts, whole and unlimited."""
    compile_plan(spec, df.columns)
    d = df
    for dim in _dimensions(spec):
        if dim.lookup is not None:
            keys = (lookups or {})[dim.lookup].select(F.col("key").alias("_k")).distinct().withColumn(f"_known_{dim.field}", F.lit(True))
            d = d.join(keys, dimension_key(d, dim) == F.col("_k"), "left").drop("_k")
    return d.where(accepted(d, spec, lookups or {})).select(df.columns)


def _measure(d: DataFrame, m: Measure) -> Column:
    if m.kind == "count":
        return F.count(F.lit(1)).cast("double")
    return F.sum(measure_number(F.col(m.field), kind_of(d, m.field)))


def ancestors(conversion: Conversion) -> dict[str, list[str]]:
    """Each category with those that it adds into, itself first."""
    parent = {c.sequence: c.parent for c in conversion.categories}
    out = {}
    for s in parent:
        chain, at = [], s
        while at is not None:
            chain.append(str(at))
            at = parent[at]
        out[str(s)] = chain
    return out


def _rolled_up(agg: DataFrame, conversion: Conversion | None) -> DataFrame:
    """Adds every row to its subtotals: a small aggregate joined to the closure of parents."""
    if conversion is None or all(c.parent is None for c in conversion.categories):
        return agg
    chains = ancestors(conversion)
    target = F.create_map(*[x for k, v in chains.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    spread = agg.withColumn("row_key", F.explode(F.coalesce(F.try_element_at(target, F.col("row_key")), F.array("row_key"))))
    values = [c for c in agg.columns if c not in ("row_key", "col_key")]
    return spread.groupBy("row_key", "col_key").agg(*[F.sum(v).alias(v) for v in values])


def _axis(agg: DataFrame, dim: Dimension | None, name: str, lookups: dict[str, DataFrame]) -> DataFrame:
    """name_key, name_label, name_sort of an axis."""
    spark = agg.sparkSession
    columns = [f"{name}_key", f"{name}_label", f"{name}_sort"]
    if dim is not None and dim.conversion is not None:
        rows = [(str(c.sequence), c.label or str(c.sequence), f"1{c.sequence:012d}") for c in dim.conversion.categories]
        rows += [(UNCLASSIFIED, UNCLASSIFIED_LABEL, "2")] if dim.unclassified == "discriminate" else []
        return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in columns))
    if dim is not None and dim.lookup is not None:
        # A key that repeats is one row; two labels for one key raise.
        once = lookups[dim.lookup].groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other"))
        label = F.when(F.col("label").eqNullSafe(F.col("other")), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("two labels for the key "), F.col("key"))).cast("string"))
        table = once.select(F.col("key").alias(columns[0]), F.concat_ws(" ", "key", label).alias(columns[1]))
        table = table.withColumn(columns[2], F.concat(F.lit("1"), natural_key(F.col(columns[0]))))
        if dim.unclassified == "discriminate":
            table = table.unionByName(spark.createDataFrame([(UNCLASSIFIED, UNCLASSIFIED_LABEL, "2")], table.schema))
        return table
    key = F.col(f"{name}_key")
    label = F.when(key == UNCLASSIFIED, UNCLASSIFIED_LABEL).otherwise(key)
    sort = F.when(key == UNCLASSIFIED, "0").otherwise(F.concat(F.lit("1"), natural_key(key), F.lit("\x00"), key))
    return agg.select(key).distinct().select(key, label.alias(columns[1]), sort.alias(columns[2]))


def tabulate(df: DataFrame, spec: TabulationSpec, lookups: dict[str, DataFrame] | None = None, counted: bool = False) -> Tabulation:
    """Checks the spec and builds the table. Where an axis lists what occurs, the records
    are aggregated here, once; else nothing runs until the cells are read.

    counted: the same aggregation also counts the records, those left out too (as one more
    group), so counters() needs no second pass. Filters then don't reach the reader, since what
    they drop must be seen."""
    lookups = lookups or {}
    plan = compile_plan(spec, df.columns)
    d = prepared(df, spec, lookups)
    keys = [_key(d, spec.rows, lookups).alias("row_key"), (_key(d, spec.columns, lookups) if spec.columns else F.lit("0")).alias("col_key")]
    measures, found = [_measure(d, m).alias(f"m{k}") for k, m in enumerate(spec.measures)], None
    if counted:
        sums = list(dict.fromkeys(m.field for m in spec.measures if m.field))
        bad = [F.count_if(not_a_number(F.col(f), kind_of(d, f))).alias(f"_bad{k}") for k, f in enumerate(sums)]
        taken = accepted(d, spec, lookups).alias("_in")
        some = [F.when(F.col("_in"), k).alias(name) for k, name in zip(keys, ("row_key", "col_key"), strict=True)]
        agg = _written(d.withColumn("_in", taken).groupBy("_in", *some).agg(*measures, F.count(F.lit(1)).alias("_n"), *bad), "counted")
        of = lambda c, taken: F.coalesce(F.sum(F.when(F.col("_in") | F.lit(not taken), F.col(c))), F.lit(0))
        found = agg.agg(of("_n", False).alias("seen"), of("_n", True).alias("accepted"), *[of(f"_bad{k}", True).alias(f"not_numbers_{f}") for k, f in enumerate(sums)])
        agg = agg.where("_in").select("row_key", "col_key", *[f"m{k}" for k in range(len(measures))])
    else:
        agg = d.where(accepted(d, spec, lookups)).groupBy(*keys).agg(*measures)
    agg = _rolled_up(agg, spec.rows.conversion)
    raw = [dim for dim in _dimensions(spec) if dim.conversion is None and dim.lookup is None]
    if raw or spec.suppress_rows or spec.suppress_columns:
        # Axes and cells both come from the aggregate: it is written once, and the records are read once.
        agg = _written(agg, "aggregate")
    rows = _axis(agg, spec.rows, "row", lookups)
    if spec.columns:
        cols = _axis(agg, spec.columns, "col", lookups)
        long = agg.withColumnRenamed("m0", "value")
    else:
        heads = [(f"m{k}", m.heading(), f"1{k:04d}") for k, m in enumerate(spec.measures)]
        cols = df.sparkSession.createDataFrame(heads, "col_key string, col_label string, col_sort string")
        long = agg.select("row_key", F.inline(F.array(*[F.struct(F.lit(k).alias("col_key"), F.col(k).alias("value")) for k, _, _ in heads])))
    # Dense by definition: the result has rows times columns cells.
    cells = rows.crossJoin(F.broadcast(cols)) if not spec.columns or spec.columns.conversion else rows.crossJoin(cols)
    cells = cells.join(long, ["row_key", "col_key"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    if spec.suppress_rows:
        cells = cells.join(cells.groupBy("row_key").agg(F.max(F.col("value") != 0).alias("some")).where("some").select("row_key"), "row_key", "left_semi")
    if spec.suppress_columns and spec.columns:
        cells = cells.join(cells.groupBy("col_key").agg(F.max(F.col("value") != 0).alias("some")).where("some").select("col_key"), "col_key", "left_semi")
    return Tabulation(plan, d, cells.select("row_key", "row_label", "col_key", "col_label", "value", "row_sort", "col_sort"), lookups, found)


def excluded_from_total(conversion: Conversion | None) -> list[str]:
    """Row keys that totals leave out: subtotals, and categories marked so."""
    if conversion is None:
        return []
    targets = {c.parent for c in conversion.categories if c.parent is not None}
    return [str(c.sequence) for c in conversion.categories if c.sequence in targets or not c.totalled]


def totals(cells: DataFrame, how: str = "sum", leave_out: list[str] | None = None, given: DataFrame | None = None) -> DataFrame:
    """col_key, total of every column: sum, product, mean, initial, final, min, max; none (null);
    precalculated (those of `given`: col_key, total, as a saved table brings them)."""
    if how in ("none", "precalculated"):
        if (how == "precalculated") == (given is None):
            raise PlanError("precalculated totals are given, others aren't")
        columns = cells.select("col_key").distinct()
        return columns.withColumn("total", F.lit(None).cast("double")) if given is None else columns.join(given.select("col_key", F.col("total").cast("double")), "col_key", "left")
    d = cells.where(~F.col("row_key").isin(*leave_out)) if leave_out else cells
    v = F.col("value")
    found = {
        "sum": F.sum(v), "product": F.product(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v),
        "initial": F.min_by(v, F.col("row_sort")), "final": F.max_by(v, F.col("row_sort")),
    }[how]
    keys = cells.select("col_key").distinct()
    return keys.join(d.groupBy("col_key").agg(found.alias("total")), "col_key", "left").select("col_key", F.coalesce("total", F.lit(0.0)).alias("total"))


def headline(cells: DataFrame, count: int = 3) -> DataFrame:
    """The rows that weigh most, with their share of the whole where that is above 0. What isn't finite counts as 0."""
    cells = cells.withColumn("value", F.when(F.abs("value") < float("inf"), F.col("value")).otherwise(0.0))
    weights = cells.groupBy("row_key", "row_label").agg(F.sum("value").alias("weight"))
    whole = weights.agg(F.sum("weight").alias("whole"))
    top = weights.orderBy(F.desc("weight"), "row_label").limit(count)
    return top.join(F.broadcast(whole)).select("row_key", "row_label", "weight", F.when(F.col("whole") > 0, F.col("weight") / F.col("whole")).alias("share"))


def headline_totals(t: Tabulation, label: str = "") -> DataFrame:
    """measure, total, categories, seen, accepted: what a headline says of a whole table."""
    finite = F.when(F.abs("value") < float("inf"), F.col("value")).otherwise(0.0)
    rows = t.cells.agg(F.coalesce(F.sum(finite), F.lit(0.0)).alias("total"), F.count_distinct("row_key").alias("categories"))
    return rows.join(F.broadcast(t.counters().select("seen", "accepted"))).select(F.lit(label.strip() or "Total").alias("measure"), "total", "categories", "seen", "accepted")
