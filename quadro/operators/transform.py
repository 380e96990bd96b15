"""Record transformation: steps over DataFrames, checked against the columns at hand.

Each step is a small dataclass with apply(df). A pipeline builds all steps before
anything runs, so a step that doesn't fit fails first; values that fail (a formula, a
join of many to many) raise when the result is read. Steps that depend on the order of
records name the columns that give it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, fields
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadro.functions import coerce
from quadro.functions.coerce import as_key, kind_of, parse_date, to_number, trim_all
from quadro.functions.formula import formula, lags, references
from quadro.operators.ordered import lagged
from quadro.operators.predicates import passing
from quadro.operators.statistics import grouped_quantiles
from quadro.plans.spec import Filter, PlanError, Rule


def _need(df: DataFrame, *names: str) -> None:
    if absent := [n for n in names if n not in df.columns]:
        raise PlanError(f"no field {', '.join(absent)}")


def _new(df: DataFrame, name: str, replaces: str | None = None) -> None:
    if name in df.columns and name != replaces:
        raise PlanError(f"field {name} exists")


def _text(df: DataFrame, name: str) -> Column:
    return trim_all(as_key(F.col(name), kind_of(df, name)))


@dataclass
class SelectColumns:
    """Keeps columns in this order; pairs (name, new name) rename."""

    columns: Sequence[str | tuple[str, str]]

    def apply(self, df: DataFrame) -> DataFrame:
        pairs = [(c, c) if isinstance(c, str) else c for c in self.columns]
        _need(df, *[a for a, _ in pairs])
        if len({b for _, b in pairs}) < len(pairs):
            raise PlanError("a column is named twice")
        return df.select(*[F.col(a).alias(b) for a, b in pairs])


@dataclass
class FilterRows:
    filters: Sequence[Filter] = ()
    rules: Sequence[Rule] = ()

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, *[f.field for f in self.filters], *[c.field for r in self.rules for c in r.conditions])
        return df.where(passing(df, tuple(self.filters), tuple(self.rules)))


@dataclass
class Recode:
    """Trimmed texts to categories; other values are kept, become null, or one category."""

    field: str
    values: dict[str, str]
    target: str | None = None
    otherwise: str = "keep"  # keep, null, or =TEXT

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.field)
        _new(df, self.target or self.field, self.field)
        text = _text(df, self.field)
        rest = F.lit(self.otherwise[1:]) if self.otherwise.startswith("=") else F.lit(None).cast("string") if self.otherwise == "null" else as_key(F.col(self.field), kind_of(df, self.field))
        out = rest
        for old, new in self.values.items():
            out = F.when(text == old, F.lit(new)).otherwise(out)
        return df.withColumn(self.target or self.field, out)


@dataclass
class MissingValues:
    """Values that stand for a missing one become null."""

    field: str
    values: Sequence[str]

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.field)
        return df.withColumn(self.field, F.when(~F.coalesce(_text(df, self.field).isin(*self.values), F.lit(False)), F.col(self.field)))


@dataclass
class Dedupe:
    """The first record of each key in the order given; nulls are equal."""

    keys: Sequence[str]
    order: Sequence[str]

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, *self.keys, *self.order)
        # min_by combines within a task first, so a key that most records share moves once. All of
        # a record comes from one min_by: where the order ties, no two records are mixed.
        first = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.struct(*[F.col(c) for c in self.order]))
        keys = [F.coalesce(as_key(F.col(k), kind_of(df, k)), F.lit("")).alias(f"_k{i}") for i, k in enumerate(self.keys)]
        return df.groupBy(*keys).agg(first.alias("_first")).select("_first.*")


@dataclass
class Derive:
    """A formula over all fields as numbers. order: of records, for LAG."""

    target: str
    formula: str
    order: Sequence[str] = ()
    division: str = "error"

    def apply(self, df: DataFrame) -> DataFrame:
        _new(df, self.target)
        values = {c: to_number(F.col(c), kind_of(df, c)) for c in df.columns if not isinstance(kind_of(df, c), (T.ArrayType, T.MapType, T.StructType, T.BinaryType))}
        references(self.formula, list(values))
        d, before = with_lags(df, [self.formula], list(values), self.order)
        made = formula(self.formula, values, missing="error", division=self.division, order=before, whole=df)
        return d.withColumn(self.target, made).select(*df.columns, self.target)


def with_lags(df: DataFrame, formulas: Sequence[str], columns: list[str], order: Sequence[str | Column]) -> tuple[DataFrame, dict[tuple[str, int], Column] | None]:
    """df with the values that the formulas' LAGs read, and these as Columns; records meet by
    their number in the order, so no task sees all of them. Without an order there are none."""
    wanted = list(dict.fromkeys(x for f in formulas for x in lags(f, columns)))
    if not wanted or not order:
        return df, None if wanted else {}
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    names = {x: f"_lag{k}" for k, x in enumerate(wanted)}
    d = lagged(df, by, {name: x for x, name in names.items()})
    return d, {x: to_number(F.col(name), kind_of(df, x[0])) for x, name in names.items()}


@dataclass
class Cast:
    """To number, text or date. What fails becomes null, or keeps its text."""

    field: str
    to: str
    on_failure: str = "missing"

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.field)
        c, kind = F.col(self.field), kind_of(df, self.field)
        text = as_key(c, kind)
        out = {"number": to_number(c, kind), "date": parse_date(c, kind), "text": text}[self.to]
        if self.on_failure == "keep" and self.to != "text":  # both kinds of values: a text column
            out = F.coalesce(as_key(out, T.DateType() if self.to == "date" else T.DoubleType()), text)
        return df.withColumn(self.field, out)


@dataclass
class DatePart:
    field: str
    part: str
    target: str

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.field)
        _new(df, self.target)
        d = parse_date(F.col(self.field), kind_of(df, self.field))
        parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "quarter": F.quarter, "epi_week": coerce.epi_week, "epi_year": coerce.epi_year}
        return df.withColumn(self.target, parts[self.part](d))


@dataclass
class NormalizeText:
    """trim, upper, lower, pad_start (size, fill), substring (start, size), municipality."""

    field: str
    operation: str
    size: int | None = None
    start: int = 1
    fill: str = "0"

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, self.field)
        text = as_key(F.col(self.field), kind_of(df, self.field))
        out = {
            "trim": lambda: trim_all(text), "upper": lambda: F.upper(text), "lower": lambda: F.lower(text),
            "pad_start": lambda: coerce.pad_start(text, self.size or 0, self.fill),
            "substring": lambda: F.substring(text, self.start, self.size or 2**31 - 1),
            "municipality": lambda: F.coalesce(coerce.municipality_code(text), text),
        }[self.operation]()
        return df.withColumn(self.field, out)


@dataclass
class GroupSummarize:
    """keys, and (measure, field, new name): count, sum, mean, median, min, max, distinct."""

    keys: Sequence[str]
    measures: Sequence[tuple[str, str | None, str]]

    def apply(self, df: DataFrame) -> DataFrame:
        _need(df, *self.keys, *[f for _, f, _ in self.measures if f])
        out, medians = [], {t: to_number(F.col(f), kind_of(df, f)) for kind, f, t in self.measures if kind == "median"}
        for kind, name, target in self.measures:
            if kind == "median":
                continue
            if kind == "count":
                out.append(F.count(F.lit(1)).alias(target))
                continue
            v = to_number(F.col(name), kind_of(df, name))
            text = as_key(F.col(name), kind_of(df, name))
            made = {"sum": F.sum(v), "mean": F.avg(v), "min": F.min(v), "max": F.max(v), "distinct": F.count_distinct(F.when(trim_all(text) != "", text))}
            out.append(made[kind].alias(target))
        if not medians:
            return df.groupBy(*self.keys).agg(*out)
        groups = df.groupBy(*self.keys).agg(*out) if out else df.select(*self.keys).distinct()
        middle = grouped_quantiles(df, self.keys, medians, 0.5).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(self.keys)})
        on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)], F.lit(True))
        return groups.join(middle, on, "left").select(*self.keys, *[t for _, _, t in self.measures])


@dataclass
class BindRows:
    """Appends another source; columns of one side only are null in the other."""

    other: DataFrame
    origin: str | None = None
    labels: tuple[str, str] = ("current", "added")

    def apply(self, df: DataFrame) -> DataFrame:
        a, b = df, self.other
        for c in set(a.columns) & set(b.columns):
            if kind_of(a, c) != kind_of(b, c):  # text holds the values of both
                a, b = a.withColumn(c, as_key(F.col(c), kind_of(a, c))), b.withColumn(c, as_key(F.col(c), kind_of(b, c)))
        if self.origin:
            _new(df, self.origin)
            a, b = a.withColumn(self.origin, F.lit(self.labels[0])), b.withColumn(self.origin, F.lit(self.labels[1]))
        return a.unionByName(b, allowMissingColumns=True)


@dataclass
class Join:
    """Joins another source on pairs of keys, compared as trimmed texts; a blank key
    matches nothing. how: inner, left, right, full."""

    other: DataFrame
    keys: Sequence[tuple[str, str]]
    how: str = "left"
    prefix: str = ""
    allow_many_to_many: bool = False

    def _keyed(self, df: DataFrame, names: list[str], side: str) -> DataFrame:
        for i, n in enumerate(names):
            text = _text(df, n)
            df = df.withColumn(f"_{side}{i}", F.when(text != "", text))
        return df

    def keyed(self, df: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
        _need(df, *[a for a, _ in self.keys])
        _need(self.other, *[b for _, b in self.keys])
        left, right = self._keyed(df, [a for a, _ in self.keys], "l"), self._keyed(self.other, [b for _, b in self.keys], "r")
        return left, right, reduce(and_, [F.col(f"_l{i}") == F.col(f"_r{i}") for i in range(len(self.keys))])

    def apply(self, df: DataFrame) -> DataFrame:
        left, right, on = self.keyed(df)
        brought = [c for c in self.other.columns if c not in {b for _, b in self.keys}]
        for c in brought:
            _new(df, f"{self.prefix}{c}")
        right = right.select(*[F.col(b).alias(f"_b{i}") for i, (_, b) in enumerate(self.keys)], *[f"_r{i}" for i in range(len(self.keys))], *[F.col(c).alias(f"{self.prefix}{c}") for c in brought])
        if not self.allow_many_to_many:
            n, twice = range(len(self.keys)), self._repeated_on_both(left, right)
            side, s = (right, "r") if self.how == "right" else (left, "l")
            side = side.join(twice, reduce(and_, [F.col(f"_{s}{i}") == F.col(f"_d{i}") for i in n]), "left")
            why = F.raise_error(F.lit("a key repeats on both sides"))
            side = side.where(F.when(F.col("_twice"), why.cast("boolean")).otherwise(F.lit(True))).drop("_twice", *[f"_d{i}" for i in n])
            left, right = (left, side) if self.how == "right" else (side, right)
        joined = left.join(right, on, {"inner": "inner", "left": "left", "right": "right", "full": "full"}[self.how])
        first = {a: i for i, (a, _) in enumerate(self.keys)}
        filled = [self._filled(df, c, first[c]) if c in first else F.col(c) for c in df.columns]
        return joined.select(*filled, *[f"{self.prefix}{c}" for c in brought])

    def _filled(self, df: DataFrame, name: str, i: int) -> Column:
        """The current key; of a source-only row the source's."""
        if self.how not in ("right", "full"):
            return F.col(name)
        a, b = kind_of(df, name), self.other.schema[self.keys[i][1]].dataType
        if a == b:
            return F.coalesce(F.col(name), F.col(f"_b{i}")).alias(name)
        return F.coalesce(as_key(F.col(name), a), as_key(F.col(f"_b{i}"), b)).alias(name)

    def _repeated_on_both(self, left: DataFrame, right: DataFrame) -> DataFrame:
        n = range(len(self.keys))
        twice = lambda d, s: d.groupBy(*[f"_{s}{i}" for i in n]).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        both = twice(left, "l").join(twice(right, "r"), reduce(and_, [F.col(f"_l{i}") == F.col(f"_r{i}") for i in n]))
        return both.select(*[F.col(f"_l{i}").alias(f"_d{i}") for i in n], F.lit(True).alias("_twice"))

    def counts(self, df: DataFrame) -> DataFrame:
        """matched, unmatched, source_only, keyless (records on either side), reading each side once.

        Records are counted by key before anything moves, so a key that most of them share is one
        row of either side."""
        left, right, on = self.keyed(df)
        n = range(len(self.keys))
        known = lambda s: reduce(and_, [F.col(f"_{s}{i}").isNotNull() for i in n])
        l = left.groupBy(*[f"_l{i}" for i in n]).agg(F.count(F.lit(1)).alias("_n")).withColumn("_lk", known("l"))  # noqa: E741
        r = right.groupBy(*[f"_r{i}" for i in n]).agg(F.count(F.lit(1)).alias("_m")).withColumn("_rk", known("r"))
        of = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
        here, there = F.col("_n").isNotNull(), F.col("_m").isNotNull()
        return l.join(r, on, "full").agg(
            of(here & there, "_n").alias("matched"), of(here & ~there, "_n").alias("unmatched"), of(there & ~here, "_m").alias("source_only"),
            (of(here & ~F.col("_lk"), "_n") + of(there & ~F.col("_rk"), "_m")).alias("keyless"))


@dataclass
class Step:
    id: str
    step: object
    enabled: bool = True


def run(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """All steps or none; a disabled step is checked but has no effect."""
    if len({s.id for s in steps}) < len(steps):
        raise PlanError("two steps have the same id")
    for s in steps:
        done = s.step.apply(df)
        df = done if s.enabled else df
    return df


def step_counts(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """step, before, after: records around every enabled step, from one run of the pipeline.

    The counts are observed within the plan. A task that Spark runs again after its output was
    lost would be counted twice; the run is then seen to have such tasks, and each step is counted
    in a pass of its own instead."""
    kept = [s for s in steps if s.enabled]
    seen, at = [Observation()], df
    at = at.observe(seen[0], F.count(F.lit(1)).alias("n"))
    for s in kept:
        seen.append(Observation())
        at = s.step.apply(at).observe(seen[-1], F.count(F.lit(1)).alias("n"))
    counts = [o.get["n"] for o in seen] if _ran_once(at) else [run(df, kept[:k]).count() for k in range(len(seen))]
    rows = [(s.id, before, after) for s, before, after in zip(kept, counts, counts[1:], strict=False)]
    return df.sparkSession.createDataFrame(rows, "step string, before bigint, after bigint")


def _ran_once(df: DataFrame) -> bool:
    """Runs a plan, to nowhere, and tells whether no task's work was done twice."""
    context, group = df.sparkSession.sparkContext, f"quadro-{uuid.uuid4().hex}"
    before = context.getLocalProperty("spark.jobGroup.id")
    context.setLocalProperty("spark.jobGroup.id", group)
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        context.setLocalProperty("spark.jobGroup.id", before)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(k) for j in tracker.getJobIdsForGroup(group) if (job := tracker.getJobInfo(j)) for k in job.stageIds]
    return all(i is None or i.currentAttemptId == 0 and i.numFailedTasks == 0 for i in stages)


def to_code(steps: Sequence[Step]) -> str:
    """The pipeline as Python that builds it again; other sources are named, not copied."""
    def shown(v: object) -> str:
        return "other" if isinstance(v, DataFrame) else repr(v)

    lines = [f"    tr.Step({s.id!r}, tr.{type(s.step).__name__}({', '.join(f'{f.name}={shown(getattr(s.step, f.name))}' for f in fields(s.step))}), {s.enabled})," for s in steps]
    return "\n".join(["steps = [", *lines, "]", "df = tr.run(df, steps)"])
