"""Profiles of fields, evidence of anomalies, and flows between places. Counts are exact:
nothing is sampled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadro.functions.coerce import as_key, kind_of, natural_key, to_number, trim_all
from quadro.operators.ordered import written
from quadro.operators.statistics import counted_quantiles, exact_quantiles, false_discovery, finite, grouped_quantiles, two_proportions, wilson

Z_MAD, IQR_TO_SD, FENCE = 0.67448975, 1.349, 1.5
EARTH_KM = 6371.0088


def values_read(df: DataFrame, name: str) -> DataFrame:
    """v (a finite number or null), blank: how a profile reads a field."""
    c, kind = F.col(name), kind_of(df, name)
    return df.select(finite(to_number(c, kind)).alias("v"), (F.coalesce(trim_all(c.cast("string")), F.lit("")) == "").alias("blank"))


def _fences(q1: float | None, q3: float | None) -> tuple[float | None, float | None]:
    return (None, None) if q1 is None else (q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1))


def _profiled(s: DataFrame, quartiles: Sequence[float | None]) -> DataFrame:
    number = lambda x, name: F.lit(x).cast("double").alias(name)
    q1, median, q3 = quartiles
    low, high = _fences(q1, q3)
    return s.select(*[c for c in s.columns if c != "outliers"], number(q1, "q1"), number(median, "median"), number(q3, "q3"), number(low, "low_fence"), number(high, "high_fence"), "outliers")


def numeric_profile(df: DataFrame, name: str) -> DataFrame:
    """total, numeric, missing, invalid, distinct, quartiles, fences, outliers of a field. Values
    that aren't finite are invalid, a NaN too."""
    d = values_read(df, name)
    quartiles = exact_quantiles(d, F.col("v"), [0.25, 0.5, 0.75])
    low, high = _fences(quartiles[0], quartiles[2])
    s = d.agg(
        F.count(F.lit(1)).alias("total"), F.count("v").alias("numeric"), F.count_if("blank").alias("missing"), F.count_if(F.col("v").isNull() & ~F.col("blank")).alias("invalid"),
        F.count_distinct("v").alias("distinct"), F.min("v").alias("min"), F.max("v").alias("max"), F.count_if((F.col("v") < low) | (F.col("v") > high)).alias("outliers"))
    return _profiled(s, quartiles)


def profile_of_counts(counts: DataFrame) -> DataFrame:
    """The numeric profile of values that are given with how often each occurs: v, blank, n (each v and blank once)."""
    quartiles = counted_quantiles(counts, [0.25, 0.5, 0.75])
    low, high = _fences(quartiles[0], quartiles[2])
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    here = F.col("v").isNotNull()
    s = counts.agg(
        of(F.lit(True)).alias("total"), of(here).alias("numeric"), of(F.col("blank")).alias("missing"), of(~here & ~F.col("blank")).alias("invalid"),
        F.count("v").alias("distinct"), F.min("v").alias("min"), F.max("v").alias("max"), of((F.col("v") < low) | (F.col("v") > high)).alias("outliers"))
    return _profiled(s, quartiles)


def combinations(df: DataFrame, names: Sequence[str], limit: int = 50) -> DataFrame:
    """The rarest combinations of values: names, records, share (a report of `limit` rows)."""
    keys = [F.coalesce(as_key(F.col(n), kind_of(df, n)), F.lit("")).alias(n) for n in names]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))
    return counts.join(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all")))).withColumn("share", F.col("records") / F.col("_all")).drop("_all").orderBy("records", F.to_json(F.array(*names))).limit(limit)


def distinct_values(df: DataFrame, name: str, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(value: the first `limit` in order; values and whether there are more)."""
    d = df.select(as_key(F.col(name), kind_of(df, name)).alias("value")).where("value is not null and value <> ''").distinct()
    return d.orderBy(natural_key(F.col("value")), "value").limit(limit), d.agg(F.count(F.lit(1)).alias("values"), (F.count(F.lit(1)) > limit).alias("truncated"))


# --- outliers ---------------------------------------------------------------------------


def numeric_outliers(df: DataFrame, name: str, keys: Sequence[str], threshold: float = 3.5) -> DataFrame:
    """keys, value, z, outside, score: values far from the median in units of the MAD (of the
    interquartile range over 1.349 where that is 0), or outside the fences of 1.5 such ranges.
    Values that aren't finite are no numbers."""
    d = df.select(*keys, finite(to_number(F.col(name), kind_of(df, name))).alias("value")).where("value is not null")
    q1, median, q3 = exact_quantiles(d, F.col("value"), [0.25, 0.5, 0.75])
    if median is None:
        return d.select("*", F.lit(None).cast("double").alias("z"), F.lit(False).alias("outside"), F.lit(0.0).alias("score")).limit(0)
    mad, = exact_quantiles(d, F.abs(F.col("value") - median), [0.5])
    iqr = q3 - q1
    scale = Z_MAD / mad if mad > 0 else IQR_TO_SD / iqr if iqr > 0 else 0.0
    low, high = q1 - FENCE * iqr, q3 + FENCE * iqr
    z, v = (F.col("value") - median) * scale, F.col("value")
    beyond = F.greatest(low - v, v - high, F.lit(0.0)) / (iqr or 1.0)
    strength = F.greatest(F.abs(z) / threshold / 2, beyond / 3)
    found = d.select("*", z.alias("z"), ((v < low) | (v > high)).alias("outside"), _percent(strength).alias("score"))
    return found.where((F.abs("z") >= threshold) | F.col("outside"))


def _percent(strength: Column) -> Column:
    """A strength from 0 to 1 as a whole number of percent, halves up."""
    return F.when(strength.isNotNull(), F.floor(100 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), strength)) + 0.5)).cast("double")


def _quantile(a: Column, share: float) -> Column:
    """Of the values of a short list, between neighbours."""
    s, at = F.array_sort(a), (F.size(a) - 1) * F.lit(share)
    below = F.floor(at).cast("int")
    return F.get(s, below) + (F.get(s, F.ceil(at).cast("int")) - F.get(s, below)) * (at - below)


def temporal_outliers(series: DataFrame, order: str, value: str, by: Sequence[str] = (), radius: int = 3, threshold: float = 3.5) -> DataFrame:
    """order, value, center, mad, z, score, outlier of a series (or of each in `by`), from the
    median and MAD around each point (the interquartile range over 1.349 where that is 0).
    Values from 0 up are compared as log(1 + value). Fewer than 3 neighbours tell nothing."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-radius, radius)
    v = F.col("value")
    d = series.select(*by, order, F.col(value).cast("double").alias("value")).withColumn("l", F.when(F.abs(v) < float("inf"), F.when(v >= 0, F.log1p(v)).otherwise(v)))
    d = d.withColumn("near", F.collect_list("l").over(w)).withColumn("mid", _quantile(F.col("near"), 0.5))
    d = d.withColumn("mad", _quantile(F.transform("near", lambda x: F.abs(x - F.col("mid"))), 0.5))
    d = d.withColumn("spread", (_quantile(F.col("near"), 0.75) - _quantile(F.col("near"), 0.25)) / IQR_TO_SD)
    away = F.col("l") - F.col("mid")
    z = F.when(F.col("mad") > 0, Z_MAD * away / F.col("mad")).when(F.col("spread") > 0, away / F.col("spread")).otherwise(away * 0)
    d = d.withColumn("z", F.when(F.size("near") >= 3, z))
    return d.select(*by, order, "value", F.expm1("mid").alias("center"), "mad", "z", _percent(F.abs("z") / (2 * threshold)).alias("score"), F.coalesce(F.abs("z") >= threshold, F.lit(False)).alias("outlier"))


# --- distributions ----------------------------------------------------------------------


def distribution_shift(group: DataFrame, reference: DataFrame, name: str) -> DataFrame:
    """js, tv, largest, score, severity: how far a field's shares differ between two sets."""
    count = lambda d, n: d.groupBy(as_key(F.col(name), kind_of(d, name)).alias("k")).agg(F.count(F.lit(1)).cast("double").alias(n)).where("k is not null")
    a, b = count(group, "a"), count(reference, "b")
    sums = a.agg(F.sum("a").alias("sa")).join(b.agg(F.sum("b").alias("sb")))
    d = a.join(b, "k", "full").join(F.broadcast(sums)).select("k", (F.coalesce("a", F.lit(0.0)) / F.col("sa")).alias("p"), (F.coalesce("b", F.lit(0.0)) / F.col("sb")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    s = d.agg((F.sum(part("p") + part("q")) / 2).alias("js"), (F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("tv"), F.max(F.abs(F.col("p") - F.col("q"))).alias("largest"))
    strength = 0.45 * F.col("js") / 0.25 + 0.35 * F.col("tv") / 0.35 + 0.20 * F.col("largest") / 0.25
    return s.withColumn("score", _percent(strength)).withColumn("severity", severity(F.col("score")))


def distribution_rows(group: DataFrame, reference: DataFrame, name: str) -> DataFrame:
    """key, left_count, right_count, left_share, right_share, difference, log2_lift of every value
    of a field in two sets; no lift where either share is 0."""
    count = lambda d, n: d.groupBy(as_key(F.col(name), kind_of(d, name)).alias("key")).agg(F.count(F.lit(1)).alias(n)).where("key is not null")
    a, b = count(group, "left_count"), count(reference, "right_count")
    d = a.join(b, "key", "full").na.fill(0, ["left_count", "right_count"])
    d = d.join(F.broadcast(a.agg(F.sum("left_count").alias("_a")).join(b.agg(F.sum("right_count").alias("_b")))))
    share = lambda c, s: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(s)), F.lit(0.0))
    d = d.withColumns({"left_share": share("left_count", "_a"), "right_share": share("right_count", "_b")})
    lift = F.when((F.col("left_share") > 0) & (F.col("right_share") > 0), F.log2(F.try_divide("left_share", "right_share")))
    return d.select("key", "left_count", "right_count", "left_share", "right_share", (F.col("left_share") - F.col("right_share")).alias("difference"), lift.alias("log2_lift"))


def severity(score: Column) -> Column:
    return F.when(score >= 75, "strong").when(score >= 40, "review").otherwise("info")


def concentration(df: DataFrame, name: str) -> DataFrame:
    """values, top_key (the most frequent, of several the first), top_share, hhi, entropy (of its largest possible) of a field."""
    c = df.groupBy(as_key(F.col(name), kind_of(df, name)).alias("k")).agg(F.count(F.lit(1)).alias("n")).where("k is not null and k <> ''")
    p = c.join(F.broadcast(c.agg(F.sum("n").alias("s")))).withColumn("p", F.col("n") / F.col("s"))
    s = p.agg(F.count(F.lit(1)).alias("values"), F.min(F.struct(-F.col("n"), "k"))["k"].alias("top_key"), F.max("p").alias("top_share"), F.sum(F.col("p") * F.col("p")).alias("hhi"), (-F.sum(F.col("p") * F.ln("p"))).alias("h"))
    return s.select("values", "top_key", "top_share", "hhi", F.when(F.col("values") > 1, F.col("h") / F.ln("values")).otherwise(0.0).alias("entropy"))


# Thresholds of the audit: an effect must be this large, and a test must agree after
# adjustment. Nothing acts on a signal by itself.
LEAST_SHIFT, LEAST_MISSING, LARGEST_Q = 0.10, 0.10, 0.05


def audit(df: DataFrame, is_group: Column, categorical: Sequence[str], numeric: Sequence[str] = (), geography: Sequence[str] = ()) -> DataFrame:
    """field, kind, key, group_share, reference_share, effect, q, severity, action.

    Compares a group of records with all others: categories that are more frequent,
    missing values, concentration in places, and outliers of the group's own numbers.
    Signals need an effect, not only a small p; `action` is always none.
    """
    d = df.withColumn("_g", F.coalesce(is_group, F.lit(False)))
    fields = list(dict.fromkeys([*categorical, *geography, *numeric]))
    keyed = [F.struct(F.lit(f).alias("field"), F.coalesce(trim_all(as_key(F.col(f), kind_of(df, f))), F.lit("")).alias("key")) for f in fields]
    counts = d.select("_g", F.inline(F.array(*keyed))).groupBy("field", "key").agg(F.count_if("_g").alias("a"), F.count_if(~F.col("_g")).alias("b"))
    sizes = F.broadcast(d.agg(F.count_if("_g").alias("n"), F.count_if(~F.col("_g")).alias("m")))
    c = counts.join(sizes).where("n > 0 and m > 0")
    c = c.where((F.col("key") == "") | F.col("field").isin(*categorical, *geography))
    tested = false_discovery(two_proportions(c, "a", "n", "b", "m").withColumn("_id", F.concat_ws("\x00", "field", "key")), "p", "_id")
    kind = F.when(F.col("key") == "", "missing").when(F.col("field").isin(*geography), "concentration").otherwise("category")
    least = F.when(F.col("key") == "", LEAST_MISSING).otherwise(LEAST_SHIFT)
    fired = tested.where((F.col("difference") >= least) & (F.col("q") <= LARGEST_Q))
    signals = fired.select("field", kind.alias("kind"), "key", (F.col("a") / F.col("n")).alias("group_share"), (F.col("b") / F.col("m")).alias("reference_share"), F.col("difference").alias("effect"), "q")
    own = d.where("_g")
    if numeric:
        found = outliers_of(own, numeric).join(F.broadcast(own.agg(F.count(F.lit(1)).alias("n")))).where("outliers > 0")
        signals = signals.unionByName(found.select(
            "field", F.lit("outlier").alias("kind"), F.lit(None).cast("string").alias("key"), (F.col("outliers") / F.col("n")).alias("group_share"), F.lit(None).cast("double").alias("reference_share"), F.col("largest").alias("effect"), F.lit(None).cast("double").alias("q")))
    grade = F.when(F.col("kind") == "outlier", F.when(F.col("effect") >= 7, "strong").otherwise("review")).when(F.col("effect") >= 0.25, "strong").otherwise("review")
    return signals.withColumn("severity", grade).withColumn("action", F.lit("none"))


def outliers_of(df: DataFrame, names: Sequence[str], threshold: float = 3.5) -> DataFrame:
    """field, values, outliers, largest (distance from the median): numeric_outliers() of many fields
    in as many passes as one takes."""
    parts = F.array(*[F.struct(F.lit(n).alias("field"), finite(to_number(F.col(n), kind_of(df, n))).alias("v")) for n in names])
    d = written(df.select(F.inline(parts)).where("v is not null"), "numbers")
    at = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    marks = None
    for name, share in at.items():
        one = grouped_quantiles(d, ["field"], {name: F.col("v")}, share)
        marks = one if marks is None else marks.join(one, "field")
    marks = written(marks, "marks")  # a row for each field
    away = d.join(F.broadcast(marks.select("field", "median")), "field").select("field", F.abs(F.col("v") - F.col("median")).alias("away"))
    marks = F.broadcast(marks.join(grouped_quantiles(away, ["field"], {"mad": F.col("away")}, 0.5), "field"))
    iqr = F.col("q3") - F.col("q1")
    scale = F.when(F.col("mad") > 0, F.lit(Z_MAD) / F.col("mad")).when(iqr > 0, F.lit(IQR_TO_SD) / iqr).otherwise(0.0)
    z = F.abs((F.col("v") - F.col("median")) * scale)
    out = (z >= threshold) | (F.col("v") < F.col("q1") - FENCE * iqr) | (F.col("v") > F.col("q3") + FENCE * iqr)
    return d.join(marks, "field").groupBy("field").agg(F.count(F.lit(1)).alias("values"), F.count_if(out).alias("outliers"), F.max(F.when(out, z)).alias("largest"))


def audit_diagnostics(df: DataFrame, is_group: Column, categorical: Sequence[str], numeric: Sequence[str] = (), geography: Sequence[str] = ()) -> DataFrame:
    """group_records, reference_records, fields_analyzed, skipped (fields of which the audit says
    nothing: numeric ones without a number in the group), warnings. Nothing is skipped for its
    size: no values are held, so there is no limit to hold them."""
    d = df.withColumn("_g", F.coalesce(is_group, F.lit(False)))
    fields = list(dict.fromkeys([*categorical, *geography, *numeric]))
    only = [f for f in fields if f not in categorical and f not in geography]
    counts = [F.count(F.when(F.col("_g"), finite(to_number(F.col(f), kind_of(df, f))))).alias(f"_{k}") for k, f in enumerate(only)]
    s = d.agg(F.count_if("_g").alias("group_records"), F.count_if(~F.col("_g")).alias("reference_records"), *counts)
    empty = F.array_compact(F.array(*[F.when(F.col(f"_{k}") == 0, F.lit(f)) for k, f in enumerate(only)])).cast("array<string>") if only else F.array().cast("array<string>")
    alone = F.when((F.col("group_records") == 0) | (F.col("reference_records") == 0), F.lit("one side has no records: nothing is compared"))
    return s.withColumn("skipped", empty).select(
        "group_records", "reference_records", (F.lit(len(fields)) - F.size("skipped")).alias("fields_analyzed"), "skipped",
        F.array_compact(F.concat(F.transform("skipped", lambda f: F.concat(f, F.lit(": no number in the group"))), F.array(alone))).alias("warnings"))


def proportions(df: DataFrame, key: str, flag: Column) -> DataFrame:
    """key, hits, total, share and Wilson's limits."""
    d = df.groupBy(key).agg(F.count_if(flag).alias("hits"), F.count(F.lit(1)).alias("total"))
    low, high = wilson(F.col("hits").cast("double"), F.col("total").cast("double"))
    return d.withColumns({"share": F.col("hits") / F.col("total"), "low": low, "high": high})


# --- flows and places -------------------------------------------------------------------


Known = DataFrame | Sequence[str] | None


def _pairs(df: DataFrame, origin: str, destination: str, weight: str | None, known: Known) -> DataFrame:
    """origin, destination (texts, blank where absent), value, weighed, records, and whether
    each place is unknown. Records are grouped by the fields as they are; texts are made of
    the few groups."""
    if weight is None:
        w = F.lit(1.0)
    else:
        number = to_number(F.col(weight), kind_of(df, weight))
        w = F.when(F.col(weight).isNull() | (F.trim(F.col(weight).cast("string")) == ""), 0.0).otherwise(number)
    d = df.groupBy(F.col(origin).alias("_o"), F.col(destination).alias("_d")).agg(F.sum(w).alias("value"), F.count(w).alias("weighed"), F.count(F.lit(1)).alias("records"))
    text = lambda c, n: F.coalesce(trim_all(as_key(F.col(c), kind_of(df, n))), F.lit(""))
    d = d.select(text("_o", origin).alias("origin"), text("_d", destination).alias("destination"), "value", "weighed", "records")
    for side in ("origin", "destination"):
        if known is None:
            d = d.withColumn(f"unknown_{side}", F.lit(False))
        elif isinstance(known, DataFrame):
            k = known.select(trim_all(F.col(known.columns[0]).cast("string")).alias("_k")).distinct().withColumn(f"unknown_{side}", F.lit(False))
            d = d.join(k, F.col(side) == F.col("_k"), "left").drop("_k").withColumn(f"unknown_{side}", F.coalesce(f"unknown_{side}", F.lit(True)))
        else:
            d = d.withColumn(f"unknown_{side}", ~F.col(side).isin(*known))
    return d


def flows(df: DataFrame, origin: str, destination: str, weight: str | None = None, known: Known = None, include_unknown: bool = False) -> DataFrame:
    """origin, destination, value, records of every pair of places.

    known: the codes of places (a list, or a table's first column); records with others are
    left out unless include_unknown. Blanks, and weights that are no numbers, are left out.
    """
    d = _pairs(df, origin, destination, weight, known).where("origin <> '' and destination <> '' and weighed > 0")
    if not include_unknown:
        d = d.where("not unknown_origin and not unknown_destination")
    return d.groupBy("origin", "destination").agg(F.sum("value").alias("value"), F.sum("weighed").alias("records"))


def flow_order() -> list[Column]:
    """The largest flow first; ties by origin and destination, numbers within them by size."""
    return [F.desc("value"), natural_key(F.col("origin")).asc(), natural_key(F.col("destination")).asc(), F.asc("origin"), F.asc("destination")]


def ordered_flows(edges: DataFrame) -> DataFrame:
    return edges.orderBy(*flow_order())


def flow_counters(df: DataFrame, origin: str, destination: str, weight: str | None = None, known: Known = None, include_unknown: bool = False) -> DataFrame:
    """records, accepted, missing_origin, missing_destination, unknown_origin,
    unknown_destination, invalid_weight. Unknown places count where both are given, weights
    of records that are otherwise accepted."""
    d = _pairs(df, origin, destination, weight, known)
    given = (F.col("origin") != "") & (F.col("destination") != "")
    taken = given if include_unknown else given & ~F.col("unknown_origin") & ~F.col("unknown_destination")
    of = lambda c, n="records": F.coalesce(F.sum(F.when(c, F.col(n))), F.lit(0)).alias
    return d.agg(
        F.coalesce(F.sum("records"), F.lit(0)).alias("records"), of(taken, "weighed")("accepted"), of(F.col("origin") == "")("missing_origin"), of(F.col("destination") == "")("missing_destination"),
        of(given & F.col("unknown_origin"))("unknown_origin"), of(given & F.col("unknown_destination"))("unknown_destination"),
        F.coalesce(F.sum(F.when(taken, F.col("records") - F.col("weighed"))), F.lit(0)).alias("invalid_weight"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def flow_distances(edges: DataFrame, points: DataFrame, unit: str = "km") -> DataFrame:
    """Adds `distance`; null where a place has no point. points: key, x (lon), y (lat)."""
    at = lambda side, k: points.select(F.col("key").alias(side), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    d = edges.join(at("origin", 1), "origin", "left").join(at("destination", 2), "destination", "left")
    c = [F.col(n) for n in ("y1", "x1", "y2", "x2")]
    made = haversine(*c) if unit == "km" else F.hypot(c[3] - c[1], c[2] - c[0])
    return d.withColumn("distance", made).select(*edges.columns, "distance")


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is inside a ring (array of x, y), by crossings."""
    return F.size(_crossed(x, y, ring)) % 2 == 1


def inside_parts(x: Column, y: Column, parts: Column) -> Column:
    """Whether a point is inside an object of several rings: islands add, holes take away."""
    return F.aggregate(parts, F.lit(0), lambda n, ring: n + F.size(_crossed(x, y, ring))) % 2 == 1


def _crossed(x: Column, y: Column, ring: Column) -> Column:
    n = F.size(ring)
    pairs = F.transform(ring, lambda p, i: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.get(ring, (i + n - 1) % n).alias("q")))
    return F.filter(pairs, lambda p: ((p["y"] > y) != (p["q"]["y"] > y)) & (x < (p["q"]["x"] - p["x"]) * F.try_divide(y - p["y"], p["q"]["y"] - p["y"]) + p["x"]))
