"""Filters, cross-field rules and code conversions as Columns."""

from __future__ import annotations

import json
from functools import reduce
from heapq import heappop, heappush
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadro.functions.coerce import as_key, filter_number, kind_of, to_number
from quadro.plans.spec import Conversion, Dimension, Filter, Rule

#: A conversion of more rules is searched as a table: a CASE of thousands isn't compiled.
MANY_RULES = 200


def segments(conversion: Conversion) -> list[tuple[str, int | None, int | None]]:
    """The rules as disjoint parts of the order of codes: (code, the category at it, that between
    it and the next), by rising code. Of the rules that cover a part the one with precedence wins.

    A sweep over the ends of all ranges: those begun wait in a heap by precedence, and the best
    one leaves it once it has ended.
    """
    raw = lambda s: s.encode()  # noqa: E731  (the order in which codes are compared)
    rules = [(k if conversion.precedence == "first" else -k, raw(r.low), raw(r.high), r.sequence) for k, r in enumerate(conversion.rules) if raw(r.low) <= raw(r.high)]
    begun = sorted(rules, key=lambda r: r[1], reverse=True)
    waiting: list[tuple[int, bytes, bytes, int]] = []
    out = []
    for code in sorted({x for _, low, high, _ in rules for x in (low, high)}):
        while begun and begun[-1][1] <= code:
            heappush(waiting, begun.pop())
        while waiting and waiting[0][2] < code:
            heappop(waiting)
        at = waiting[0][3] if waiting else None
        while waiting and waiting[0][2] <= code:
            heappop(waiting)
        out.append((code.decode(), at, waiting[0][3] if waiting else None))
    return out


def _searched(code: Column, conversion: Conversion) -> Column:
    """The category of a code by binary search of the segments, which are literals of the plan."""
    found = segments(conversion)
    if not found:
        return F.lit(None).cast("int")
    column = lambda k, kind: F.from_json(F.lit(json.dumps([s[k] for s in found])), F.lit(f"array<{kind}>"))
    codes, at, between = column(0, "string"), column(1, "int"), column(2, "int")
    steps = F.sequence(F.lit(1), F.lit(max(1, len(found).bit_length())))
    halved = lambda s, _: F.when(F.get(codes, F.floor((s["low"] + s["high"]) / 2).cast("int")) <= code, F.struct(F.floor((s["low"] + s["high"]) / 2).cast("int").alias("low"), s["high"].alias("high"))).otherwise(
        F.struct(s["low"].alias("low"), F.floor((s["low"] + s["high"]) / 2).cast("int").alias("high")))
    # low: the last segment known to begin at or before the code (-1: none); high: the first known to begin after it.
    place = F.aggregate(steps, F.struct(F.lit(-1).alias("low"), F.lit(len(found)).alias("high")), lambda s, k: F.when(s["high"] - s["low"] > 1, halved(s, k)).otherwise(s), lambda s: s["low"])
    return F.transform(F.array(place), lambda p: F.when(p >= 0, F.when(F.get(codes, p) == code, F.get(at, p)).otherwise(F.get(between, p))))[0]


def classify(df: DataFrame, name: str, conversion: Conversion, start: int = 1) -> Column:
    """The sequence of the category that a value belongs to, or null."""
    if conversion.bands:
        text = F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
        number = F.when(F.col(name).isNotNull() & (text == ""), F.lit(0.0)).otherwise(to_number(F.col(name), kind_of(df, name)))
        found = F.lit(None).cast("int")
        for sequence, upper in reversed(conversion.bands):
            found = F.when(number <= upper, F.lit(sequence)).otherwise(found)
        return found
    code = F.substring(F.coalesce(as_key(F.col(name), kind_of(df, name)), F.lit("")), start, conversion.code_length)
    if len(conversion.rules) > MANY_RULES:
        return _searched(code, conversion)
    # The winning rule is tested first.
    ordered = conversion.rules if conversion.precedence == "first" else conversion.rules[::-1]
    found = F.lit(None).cast("int")
    for r in reversed(ordered):
        hit = code == r.low if r.low == r.high else code.between(r.low, r.high)
        found = F.when(hit, F.lit(r.sequence)).otherwise(found)
    return found


def matches(df: DataFrame, f: Filter) -> Column:
    """Whether a record meets a filter: true or false, never null."""
    c, kind = F.col(f.field), kind_of(df, f.field)
    if f.conversion is not None:
        sequence = classify(df, f.field, f.conversion, f.start)
        found = F.coalesce(sequence.cast("string").isin(*(f.categories or ())), F.lit(f.include_unclassified))
    elif f.categories is not None:
        text = c if isinstance(kind, T.StringType) else as_key(c, kind)
        found = text.isin(*f.categories)
        # Blanks are a category of their own. Where that can't matter the bare test stays,
        # which the reader of Parquet files can use.
        if "" in f.categories or f.mode == "exclude":
            found = F.coalesce(text, F.lit("")).isin(*f.categories)
    else:
        v = filter_number(c, kind)
        low = F.lit(True) if f.low is None else v > f.low if f.low_open else v >= f.low
        high = F.lit(True) if f.high is None else v < f.high if f.high_open else v <= f.high
        found = low & high
    if f.mode == "exclude":
        return ~F.coalesce(found, F.lit(False))
    return found if f.categories is not None and f.conversion is None and "" not in f.categories else F.coalesce(found, F.lit(False))


def meets(df: DataFrame, rule: Rule) -> Column:
    return F.coalesce(reduce(and_, [F.coalesce(matches(df, c), F.lit(False)) for c in rule.conditions]), F.lit(False))


def passing(df: DataFrame, filters: tuple[Filter, ...], rules: tuple[Rule, ...] = ()) -> Column:
    """Whether a record stays: no excluding rule met, all filters met."""
    tests = [~meets(df, r) for r in rules if r.action == "exclude"] + [matches(df, f) for f in filters]
    return reduce(and_, tests, F.lit(True))


def rule_counts(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """rule, action, records: how many of all records meet each rule."""
    counted = df.agg(*[F.count_if(meets(df, r)).alias(str(k)) for k, r in enumerate(rules)])
    rows = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"), F.col(str(k)).alias("records")) for k, r in enumerate(rules)])
    return counted.select(F.inline(rows))


def dimension_key(df: DataFrame, d: Dimension) -> Column:
    """A record's key on an axis; null where it has none."""
    if d.conversion is not None:
        return classify(df, d.field, d.conversion, d.start).cast("string")
    text = as_key(F.col(d.field), kind_of(df, d.field))
    if d.lookup is not None:
        text = F.trim(text)
    if d.start > 1 or d.length is not None:
        text = F.substring(text, d.start, d.length or 2**31 - 1)
    return F.when(text != "", text)
