"""Statistics and rates: aggregates and closed forms. Values that aren't finite numbers
are left out, and what has no value is null, never 0."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadro.functions.coerce import kind_of, normal_cdf, to_number
from quadro.operators.ordered import PLACE, RANGE, before, in_ranges, written

Z95 = 1.959963984540054
#: Upper limit of a rate without events: -ln(0.025).
NO_EVENTS_UPPER = 3.6888794541139363


def _v(df: DataFrame, name: str) -> Column:
    return finite(to_number(F.col(name), kind_of(df, name)))


def finite(v: Column) -> Column:
    return F.when(F.abs(v) < float("inf"), v)


#: Values that are brought together to be sorted, and the accuracy of the sketches.
SORTED, ACCURACY = 1 << 16, 10_000


def exact_quantiles(df: DataFrame, value: Column, shares: Sequence[float]) -> list[float | None]:
    """Quantiles of all values, interpolated between neighbours; None without values.

    A sketch gives a narrow range around each; the values below it are counted, and only
    those inside are sorted. A range of more than SORTED values is narrowed in the same way,
    so no task holds a column's values. Three passes over the data, each aggregated in place.
    """
    d = df.select(value.cast("double").alias("v")).where("v is not null")
    return _quantiles(d, [(s, None) for s in shares], None)


def _quantiles(d: DataFrame, asked: list[tuple[float, int | None]], n: int | None) -> list[float | None]:
    """asked: shares, or positions (from 0) in the order of d's n values."""
    margin = 2 / ACCURACY
    near = [s if k is None else k / max(1, n - 1) for s, k in asked]
    edges = [min(1.0, max(0.0, s + side * margin)) for s in near for side in (-1, 1)]
    total, cuts = d.agg(F.count(F.lit(1)), F.percentile_approx("v", edges, ACCURACY)).first()
    if not total:
        return [None] * len(asked)
    at = [s * (total - 1) if k is None else float(k) for s, k in asked]
    ranges = list(zip(cuts[::2], cuts[1::2], strict=True))
    inside = [F.col("v").between(a, z) for a, z in ranges]
    counts = d.agg(*[c for (a, _), i in zip(ranges, inside, strict=True) for c in (F.count_if(F.col("v") < a), F.count_if(i))]).first()
    below, held = counts[::2], counts[1::2]
    good = [b <= math.floor(x) and math.ceil(x) < b + h for x, b, h in zip(at, below, held, strict=True)]
    if all(good) and sum(held) <= SORTED * len(asked):
        chosen = d.where(reduce(or_, [F.col("v").between(F.lit(a), F.lit(z)) for a, z in dict.fromkeys(ranges)]))
        found = sorted((r[0], r[1]) for r in chosen.groupBy("v").count().collect())
        return [_between([(v, c) for v, c in found if a <= v <= z], x - b) for x, b, (a, z) in zip(at, below, ranges, strict=True)]
    out: list[float | None] = []
    for x, b, h, (a, z) in zip(at, below, held, ranges, strict=True):
        ends = []
        for k in dict.fromkeys((math.floor(x), math.ceil(x))):
            if b <= k < b + h and a == z:
                ends.append(a)
            elif b <= k < b + h and h < total:
                ends += _quantiles(d.where(F.col("v").between(a, z)), [(0.0, k - b)], h)
            elif k < b:
                ends += _quantiles(d.where(F.col("v") < a), [(0.0, k)], b)
            elif k >= b + h:
                ends += _quantiles(d.where(F.col("v") > z), [(0.0, k - b - h)], total - b - h)
            else:  # the range is all there is: take off the rows at its ends, which may be most of them
                first, last = d.agg(F.count_if(F.col("v") == a), F.count_if(F.col("v") == z)).first()
                if k < first or k >= total - last:
                    ends.append(a if k < first else z)
                else:
                    ends += _quantiles(d.where((F.col("v") > a) & (F.col("v") < z)), [(0.0, k - first)], total - first - last)
        out.append(ends[0] + (ends[-1] - ends[0]) * (x - math.floor(x)))
    return out


def _between(counted: list[tuple[float, int]], x: float) -> float:
    """The value at position x of sorted values with their counts."""
    ends, seen = [], 0
    for v, c in counted:
        seen += c
        while len(ends) < 2 and (math.floor(x), math.ceil(x))[len(ends)] < seen:
            ends.append(v)
    return ends[0] + (ends[1] - ends[0]) * (x - math.floor(x))


#: Values of one group and measure that are gathered to be sorted; cuts of the sketches that narrow larger groups.
GATHERED, CUTS = 1 << 14, 100
#: Up to so many large groups are broadcast.
FEW = 1 << 16


def grouped_quantiles(df: DataFrame, keys: Sequence[str], values: dict[str, Column], share: float) -> DataFrame:
    """keys, and by name a quantile of each value in each group, interpolated between neighbours.

    Groups of at most GATHERED values are sorted. For all larger ones at once, whatever their
    number, passes narrow an open range around each wanted place: a sketch proposes its ends, and
    exact counts decide on which side of them, or on which of them, the place is. So no task
    holds a group, and a group that is most of the rows is aggregated where it lies.
    """
    names = list(values)
    at = [f"_k{i}" for i in range(len(keys))]
    parts = F.array(*[F.struct(F.lit(i).alias("_m"), v.cast("double").alias("_v")) for i, v in enumerate(values.values())])
    rows = df.select(*[F.col(k).alias(a) for k, a in zip(keys, at, strict=True)], F.inline(parts)).where("_v is not null")
    pair = [*at, "_m"]
    same = lambda d: reduce(and_, [F.col(c).eqNullSafe(F.col(f"t{c}")) for c in pair])  # noqa: E731, ARG005
    sizes = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > GATHERED)
    large = written(sizes, "large")
    many = large.count()
    sided = lambda d: F.broadcast(d) if many <= FEW else d
    marked = lambda d: d.withColumnsRenamed({c: f"t{c}" for c in pair})

    place = lambda n: (F.col(n) - 1) * F.lit(float(share))
    small = rows if not many else rows.join(sided(marked(large)), same(large), "left_anti")
    small = small.groupBy(*pair).agg(F.sort_array(F.collect_list("_v")).alias("_s")).withColumn("_p", (F.size("_s") - 1) * F.lit(float(share)))
    low, high = F.get("_s", F.floor("_p").cast("int")), F.get("_s", F.ceil("_p").cast("int"))
    found = small.select(*pair, (low + (high - low) * (F.col("_p") - F.floor("_p"))).alias("_q"))
    if many:
        ends = F.explode(F.array_distinct(F.array(F.floor(place("_n")), F.ceil(place("_n")))))
        none = F.lit(None).cast("double")
        asked = large.select(*pair, ends.alias("_at"), none.alias("_lo"), none.alias("_hi"), F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_held"), none.alias("_value"))
        while not (asked := written(asked, "asked")).where((F.col("_held") > GATHERED) & F.col("_value").isNull()).isEmpty():
            asked = _narrowed(rows, asked, pair, sided)
        # What is left of each range fits in one place.
        left = _inside(rows, asked.where("_value is null"), pair, sided).groupBy(*pair, "_at").agg(F.sort_array(F.collect_list("_v")).alias("_s"))
        done = asked.join(left.withColumnsRenamed({c: f"t{c}" for c in [*pair, "_at"]}), same(asked) & (F.col("_at") == F.col("t_at")), "left")
        done = done.select(*pair, "_at", F.coalesce("_value", F.get("_s", (F.col("_at") - F.col("_below")).cast("int"))).alias("_value"))
        step = large.withColumnsRenamed({c: f"t{c}" for c in pair})
        both = done.join(sided(step), same(done)).groupBy(*pair).agg(F.min("_value").alias("_a"), F.max("_value").alias("_b"), F.max(place("_n") - F.floor(place("_n"))).alias("_w"))
        found = found.unionByName(both.select(*pair, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias("_q")))
    wide = found.groupBy(*at).agg(*[F.max(F.when(F.col("_m") == i, F.col("_q"))).alias(name) for i, name in enumerate(names)])
    return wide.withColumnsRenamed(dict(zip(at, keys, strict=True)))


def _inside(rows: DataFrame, asked: DataFrame, pair: list[str], sided) -> DataFrame:  # noqa: ANN001
    """The rows within the open range of each place asked for."""
    t = sided(asked.withColumnsRenamed({c: f"t{c}" for c in pair}))
    d = rows.join(t, reduce(and_, [F.col(c).eqNullSafe(F.col(f"t{c}")) for c in pair])).drop(*[f"t{c}" for c in pair])
    return d.where((F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi"))))


def _narrowed(rows: DataFrame, asked: DataFrame, pair: list[str], sided) -> DataFrame:  # noqa: ANN001
    """asked with narrower ranges, or with values where a place is on an end."""
    open_ones = asked.where((F.col("_held") > GATHERED) & F.col("_value").isNull())
    one = [*pair, "_at"]
    cuts = _inside(rows, open_ones, pair, sided).groupBy(*one).agg(F.percentile_approx("_v", [k / CUTS for k in range(CUTS + 1)], 10 * CUTS).alias("_c"))
    key = reduce(and_, [F.col(c).eqNullSafe(F.col(f"t{c}")) for c in one])
    near = F.floor((F.col("_at") - F.col("_below")) * CUTS / F.greatest(F.col("_held") - 1, F.lit(1))).cast("int")
    bounds = open_ones.join(cuts.withColumnsRenamed({c: f"t{c}" for c in one}), key).select(*one, "_lo", "_hi", "_below", "_held", F.get("_c", F.greatest(near - 1, F.lit(0))).alias("_a"), F.get("_c", F.least(near + 2, F.lit(CUTS))).alias("_b"))
    bounds = written(bounds, "bounds")
    v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
    counts = _inside(rows, bounds, pair, sided).groupBy(*one).agg(F.count_if(v < a).alias("_1"), F.count_if(v == a).alias("_2"), F.count_if((v > a) & (v < b)).alias("_3"), F.count_if((v == b) & (a < b)).alias("_4"))
    d = bounds.join(counts.withColumnsRenamed({c: f"t{c}" for c in one}), key)
    k = F.col("_at") - F.col("_below")
    ends = [F.col("_1"), F.col("_1") + F.col("_2"), F.col("_1") + F.col("_2") + F.col("_3"), F.col("_1") + F.col("_2") + F.col("_3") + F.col("_4")]
    pick = lambda *five: F.when(k < ends[0], five[0]).when(k < ends[1], five[1]).when(k < ends[2], five[2]).when(k < ends[3], five[3]).otherwise(five[4])
    none = F.lit(None).cast("double")
    new = d.select(
        *one, pick(F.col("_lo"), none, a, none, b).alias("_lo"), pick(a, none, b, none, F.col("_hi")).alias("_hi"),
        (F.col("_below") + pick(F.lit(0), F.lit(0), ends[1], F.lit(0), ends[3])).alias("_below"), pick(F.col("_1"), F.lit(0), F.col("_3"), F.lit(0), F.col("_held") - ends[3]).alias("_held"), pick(none, a, none, b, none).alias("_value"))
    return asked.where(~((F.col("_held") > GATHERED) & F.col("_value").isNull())).unionByName(new)


def counted_quantiles(counts: DataFrame, shares: Sequence[float], value: str = "v", times: str = "n") -> list[float | None]:
    """Quantiles of values given with how often each occurs (each value once); None without values.

    Values are dealt to ranges of their order; running sums of the counts, within ranges and
    from range to range, find the few that are at the places wanted."""
    d = in_ranges(counts.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.col(times).alias("n")), [F.col("v").asc()])
    total = d.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(shares)
    at = [s * (total - 1) for s in shares]
    start = before(d, {"_start": (F.sum("n"), F.sum("_start"))})
    end = F.sum("n").over(Window.partitionBy(RANGE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.coalesce("_start", F.lit(0))
    d = d.join(F.broadcast(start), RANGE).select("v", "n", end.alias("end"))
    wanted = sorted({k for x in at for k in (math.floor(x), math.ceil(x))})
    hit = reduce(or_, [(F.col("end") > k) & (F.col("end") - F.col("n") <= k) for k in wanted])
    found = d.where(hit).collect()  # one row at most for each place
    of = {k: next(r.v for r in found if r.end - r.n <= k < r.end) for k in wanted}
    return [of[math.floor(x)] + (of[math.ceil(x)] - of[math.floor(x)]) * (x - math.floor(x)) for x in at]


def _moments(v: Column) -> list[Column]:
    var = F.when(F.count(v) == 1, 0.0).otherwise(F.var_samp(v))
    return [F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), var.alias("variance"), F.sqrt(var).alias("sd")]


def descriptive(df: DataFrame, name: str) -> DataFrame:
    """count, sum, mean, min, max, median, variance, sd (of a sample; of one value 0)."""
    v = _v(df, name)
    median, = exact_quantiles(df, v, [0.5])
    return df.agg(*_moments(v)).select("count", "sum", "mean", "min", "max", F.lit(median).cast("double").alias("median"), "variance", "sd")


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, pearson over the rows that have both; fewer than two of them, or a constant side, raise."""
    a, b = _v(df, x), _v(df, y)
    d = df.where(a.isNotNull() & b.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("c"))
    made = F.col("c") / F.sqrt(F.col("va") * F.col("vb"))
    return d.select("n", _defined(made, "a correlation", (F.col("va") > 0) & (F.col("vb") > 0)).alias("pearson"))


def _defined(value: Column, what: str, varies: Column) -> Column:
    """The value, or the reason why there is none."""
    raised = lambda why: F.raise_error(F.lit(f"{what} {why}")).cast("double")
    return F.when(F.col("n") < 2, raised("needs two finite pairs at least")).when(~varies, raised("of a constant is undefined")).otherwise(value)


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, slope, intercept, r2 of y on x; fewer than two pairs or a constant x raise."""
    a, b = _v(df, x), _v(df, y)
    d = df.agg(F.regr_count(b, a).alias("n"), F.regr_sxx(b, a).alias("sxx"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))
    return d.select("n", _defined(F.col("slope"), "a regression", F.col("sxx") > 0).alias("slope"), "intercept", "r2")


def histogram(df: DataFrame, name: str, bins: int | None = None) -> DataFrame:
    """bin, low, high, count. Without a number of bins, Sturges' rule; 50 at most. A
    constant has one bin; the largest value is in the last one."""
    d = df.select(_v(df, name).alias("v")).where("v is not null")
    asked = F.lit(bins) if bins else F.ceil(F.log2(F.col("n")) + 1)
    s = d.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    s = s.withColumn("k", F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(50), asked)))).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("k"))
    at = F.when(F.col("w") == 0, 0).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.col("k") - 1)).cast("int")
    counts = d.join(F.broadcast(s)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    all_bins = s.select("lo", "w", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))).alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def gaussian_overlay(df: DataFrame, name: str, bins: int | None = None) -> DataFrame:
    """Each bin with the count that a normal distribution of the same mean and sd expects."""
    s = F.broadcast(df.agg(*_moments(_v(df, name))).select("count", "mean", "sd").withColumnsRenamed({"count": "n"}))
    mid, width = (F.col("low") + F.col("high")) / 2, F.col("high") - F.col("low")
    density = F.exp(-F.pow((mid - F.col("mean")) / F.col("sd"), 2) / 2) / (F.col("sd") * F.sqrt(2 * F.pi()))
    return histogram(df, name, bins).join(s).select("bin", "low", "high", "count", F.when(F.col("sd") > 0, density * width * F.col("n")).alias("expected"))


# --- rates ------------------------------------------------------------------------------


def byar(events: Column) -> tuple[Column, Column]:
    """Byar's 95 % limits of a count."""
    e, up = events, events + 1
    low = e * F.pow(1 - 1 / (9 * e) - Z95 / (3 * F.sqrt(e)), 3)
    high = up * F.pow(1 - 1 / (9 * up) + Z95 / (3 * F.sqrt(up)), 3)
    return F.when(e == 0, 0.0).otherwise(low), F.when(e == 0, NO_EVENTS_UPPER).otherwise(high)


def whole_events(events: Column, label: Column) -> Column:
    """Events as given; a fraction or a negative number raises with the stratum's name."""
    return F.when((events == F.floor(events)) & (events >= 0), events).otherwise(F.raise_error(F.concat(F.lit("events aren't a whole number in "), label)).cast("double"))


def crude_rate(df: DataFrame, label: str, events: str, population: str, scale: float = 100_000) -> DataFrame:
    """label, rate, low, high (95 %, Byar); null where there is no population."""
    e, p = whole_events(_v(df, events), F.col(label).cast("string")), _v(df, population)
    low, high = byar(e)
    per = lambda x: F.when(p > 0, x / p * scale)
    return df.select(label, per(e).alias("rate"), per(low).alias("low"), per(high).alias("high"))


def _not_negative(v: Column, what: str, label: Column) -> Column:
    """A population, weight or rate as given; an absent or negative one raises."""
    return F.when(v >= 0, v).otherwise(F.raise_error(F.concat(F.lit(f"{what} isn't valid in "), label)).cast("double"))


def _strata(df: DataFrame, label: str | None, events: str, population: str, third: str, what: str) -> DataFrame:
    """e, p, s of strata, checked; used: whether population and the third are above 0."""
    name = F.lit("a stratum") if label is None else F.coalesce(F.col(label).cast("string"), F.lit("?"))
    d = df.select(whole_events(_v(df, events), name).alias("e"), _not_negative(_v(df, population), "population", name).alias("p"), _not_negative(_v(df, third), what, name).alias("s"))
    return d.withColumn("used", (F.col("p") > 0) & (F.col("s") > 0))


def direct_standardization(df: DataFrame, events: str, population: str, standard: str, scale: float = 100_000, label: str | None = None) -> DataFrame:
    """rate, low, high, error, crude, used, skipped: strata weighted by a standard population.

    Strata without population or weight are skipped, not zero; they count in the crude rate.
    Events that aren't whole numbers, and negative or absent populations and weights, raise.
    """
    d = _strata(df, label, events, population, standard, "standard weight")
    if_used = lambda c: F.sum(F.when(F.col("used"), c))
    a = d.agg(
        if_used(F.col("s")).alias("w"), if_used(F.col("s") * F.try_divide("e", "p")).alias("r"), if_used(F.col("s") * F.col("s") * F.try_divide("e", F.col("p") * F.col("p"))).alias("v"),
        F.try_divide(F.sum("e"), F.sum("p")).alias("crude"), F.count_if("used").alias("used"), F.count_if(~F.col("used")).alias("skipped"))
    rate, sd = F.col("r") / F.col("w") * scale, F.sqrt("v") / F.col("w") * scale
    return a.select(rate.alias("rate"), F.greatest(F.lit(0.0), rate - Z95 * sd).alias("low"), (rate + Z95 * sd).alias("high"), sd.alias("error"), (F.col("crude") * scale).alias("crude"), "used", "skipped")


def indirect_standardization(df: DataFrame, events: str, population: str, reference_rate: str, per: float = 100_000, label: str | None = None) -> DataFrame:
    """observed, expected, smr, low, high, used, skipped: events over those that reference
    rates expect. Strata without population or rate are skipped in what is expected."""
    d = _strata(df, label, events, population, reference_rate, "reference rate")
    a = d.agg(F.sum("e").alias("observed"), F.coalesce(F.sum(F.when(F.col("used"), F.col("p") * F.col("s") / per)), F.lit(0.0)).alias("expected"), F.count_if("used").alias("used"), F.count_if(~F.col("used")).alias("skipped"))
    low, high = byar(F.col("observed"))
    over = lambda x: F.when(F.col("expected") > 0, x / F.col("expected"))
    return a.select("observed", "expected", over(F.col("observed")).alias("smr"), over(low).alias("low"), over(high).alias("high"), "used", "skipped")


def rate_ratio(rate_a: Column, sd_a: Column, rate_b: Column, sd_b: Column) -> tuple[Column, Column, Column]:
    """Ratio of two standardized rates with 95 % limits on the log scale; a rate of 0 above has no limits."""
    ratio = F.when(rate_b > 0, rate_a / rate_b)
    spread = F.sqrt(F.pow(sd_a / rate_a, 2) + F.pow(sd_b / rate_b, 2))
    sided = lambda sign: F.when((rate_a > 0) & (rate_b > 0), ratio * F.exp(sign * Z95 * spread))
    return ratio, sided(-1), sided(1)


# --- proportions ------------------------------------------------------------------------


def wilson(hits: Column, total: Column) -> tuple[Column, Column]:
    """Wilson's 95 % limits of a proportion."""
    p, z2 = hits / total, Z95 * Z95
    mid = (p + z2 / (2 * total)) / (1 + z2 / total)
    half = Z95 * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total)) / (1 + z2 / total)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)


def two_proportions(df: DataFrame, hits: str, total: str, other_hits: str, other_total: str) -> DataFrame:
    """difference, ratio, odds_ratio, z, p, and Wilson's limits of both shares (low, high,
    other_low, other_high) for each row of counts. No odds ratio where the odds of either
    side aren't finite."""
    a, n, b, m = (F.col(c).cast("double") for c in (hits, total, other_hits, other_total))
    p, q, both = a / n, b / m, (a + b) / (n + m)
    se = F.sqrt(both * (1 - both) * (1 / n + 1 / m))
    z = F.when(se > 0, (p - q) / se)
    odds = F.when(b < m, F.try_divide(a * (m - b), b * (n - a)))
    limits = [c.alias(k) for c, k in zip((*wilson(a, n), *wilson(b, m)), ("low", "high", "other_low", "other_high"), strict=True)]
    return df.select("*", (p - q).alias("difference"), F.when(q > 0, p / q).alias("ratio"), odds.alias("odds_ratio"), z.alias("z"), (2 * (1 - normal_cdf(F.abs(z)))).alias("p"), *limits)


def false_discovery(df: DataFrame, p: str, key: str) -> DataFrame:
    """Adds `q`, the Benjamini-Hochberg adjusted p; ties by key. A null p is no test and has no q.

    Tests are dealt to ranges of p. The ranges' counts give ranks, their smallest p x n / rank,
    taken from the largest p down, what each range's own running minimum goes on from."""
    d = in_ranges(df, [F.col(p).asc_nulls_last(), F.col(key).asc()])
    share = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(p))))
    start = before(d, {"_start": (F.count(p), F.sum("_start"))})
    n = F.broadcast(d.agg(F.count(p).alias("_n")))
    d = d.join(F.broadcast(start), RANGE).join(n).withColumn("_raw", share * F.col("_n") / (F.coalesce("_start", F.lit(0)) + F.col(PLACE) + 1))
    later = before(d, {"_later": (F.min("_raw"), F.min("_later"))}, backwards=True)
    own = F.min("_raw").over(Window.partitionBy(RANGE).orderBy(PLACE).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    d = d.withColumn("_own", own).join(F.broadcast(later), RANGE)
    q = F.least(F.lit(1.0), F.col("_own"), F.col("_later"))
    return d.select(*[F.col(f"`{c}`") for c in df.columns], F.when(F.col(p).isNotNull(), q).alias("q"))
