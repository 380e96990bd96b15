"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies, in proportion to its importance (in
STEPS steps for each doubling) but `most` at most: what more important documents can't
take goes to the others of their source, so that the expected words are the source's
target. The whole part of it is allocated for certain.
The rest is the inclusion probability p of one more copy. These are drawn by Pareto
order sampling: rank by the odds of a uniform number over the odds of p, and take
documents in that order while they fit the words that remain of the source's target.
The sample has a fixed size in words, and inclusion is near p for each. What the first
document that doesn't fit leaves open is filled from the next ones, FILLS times.

No source is ordered as a whole. Ranks are counted in BUCKETS buckets a source; whole
buckets before the cut are taken, and only the bucket that the cut falls in is
sorted, so the largest sorted group is a source's rows over BUCKETS. Sources are a
small table: one row each, and the only thing that a single task orders.

Defined cases: null texts have size 0; a source without words gets target 0; a null
source is a source of its own, last in order; ranks come from a hash of doc_id, so
reruns agree, and ties in rank go by doc_id and size; rows that repeat a doc_id are
separate units with equal rank, and a row number, if given, decides between them and
ranks rows without a doc_id; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadro.llm.common import stage, word_count

BUCKETS, FILLS, SEED, MAX_COPIES, STEPS = 4096, 3, 20240229, 3, 8


def source_targets(sizes: DataFrame, most: int = MAX_COPIES, weight: Column | None = None) -> DataFrame:
    """source, source_size, target. sizes: source, source_size.

    Sources by code point, null last, weigh 1, 2, 3, repeating (or as `weight` says, a
    column over `position`, which counts from 0). They share the total by weight; a
    target stops at `most` times its source's size and the excess is shared again.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    w = weight if weight is not None else F.col("position") % 3 + 1
    d = sizes.withColumn("position", F.row_number().over(order) - 1).withColumn("w", w.cast("double"))
    d = d.withColumn("cap", F.col("source_size") * F.lit(most))
    # By cap over weight, the capped sources come first: all before a row being capped,
    # `level` is what the others get for each unit of weight.
    before = Window.orderBy(F.col("cap") / F.col("w"), "position").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    d = d.withColumn("level", left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    d = d.withColumn("free", F.col("cap") > F.col("w") * F.col("level"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "position", "level"))).over(every)
    d = d.withColumn("share", F.col("w") * first["level"])
    return d.select("source", "source_size", F.when(F.col("free"), F.col("share")).otherwise(F.col("cap")).cast("double").alias("target"))


def uniform(seed: int, *columns: str | Column) -> Column:
    """A number strictly between 0 and 1 for each value of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / F.lit(float(2**53))


def mix(docs: DataFrame, importance: Column | None = None, most: int = MAX_COPIES, weight: Column | None = None, seed: int = SEED, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of docs.

    row: a column of docs that numbers its rows, returned as well.

    importance: a positive factor of a document's expected copies (over columns of docs;
    1 where it is null or not positive).
    """
    one = F.lit(1.0)
    if importance is not None:
        one = F.coalesce(F.when(importance > 0, F.pow(2.0, F.round(F.log2(importance.cast("double")) * STEPS) / STEPS)), one)
    numbers = [row] if row else []
    sized = stage(docs.select("doc_id", "source", word_count("text").alias("size"), one.alias("importance"), *numbers), "sized")
    classes = stage(sized.groupBy("source", "importance").agg(F.sum("size").alias("words")), "importances")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), most, weight)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    plan = stage(targets.join(levels := _levels(classes, targets, most), same(targets, levels)).select(targets["*"], "level"), "targets")

    d = sized.join(plan, same(sized, plan)).select(sized["*"], "source_size", "target", "level")
    expected = F.least(F.lit(float(most)), F.coalesce(F.col("level") * F.col("importance"), F.lit(float(most))))
    expected = F.when(F.col("source_size") > 0, expected).otherwise(0.0)
    d = d.withColumn("expected", expected).withColumn("whole", F.floor("expected"))
    p, u = F.col("expected") - F.col("whole"), uniform(seed, "doc_id", *[F.when(F.col("doc_id").isNull(), F.col(c)) for c in numbers])
    # Odds over odds, mapped to 0..1 in the same order; null where there is nothing to draw.
    d = d.withColumn("rank", F.when(p > 0, u * (1 - p) / (u * (1 - p) + p * (1 - u))))
    d = d.withColumn("more", F.lit(0).cast("long")).drop("level", "expected", "importance")
    for k in range(FILLS):
        d = stage(_fill(d, k == FILLS - 1, numbers), f"drawn-{k}")
    d = d.withColumn("copies", F.col("whole") + F.col("more"))
    return d.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *numbers)


def _levels(classes: DataFrame, targets: DataFrame, most: int) -> DataFrame:
    """source, level: the expected copies of a document of importance 1 (null: every
    document has `most`). By falling importance, classes take `most` copies until the rest
    of the target, shared by importance, gives the next class no more than that."""
    d = classes.join(targets, classes["source"].eqNullSafe(targets["source"])).select(classes["*"], "target")
    falling = Window.partitionBy("source").orderBy(F.desc("importance"))
    full = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * most
    mass = F.sum(F.col("words") * F.col("importance")).over(falling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    d = d.withColumn("level", F.try_divide(F.col("target") - full, mass)).withColumn("fits", F.col("level") * F.col("importance") <= most)
    return d.groupBy("source").agg(F.max_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), F.col("importance"))).alias("level"))


def _fill(d: DataFrame, last: bool, numbers: list[str]) -> DataFrame:
    """Draws documents by rank while they fit what remains of their source's target. The
    last time, the document that the target falls in comes too if that is nearer."""
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    gaps = stage(d.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * (F.col("whole") + F.col("more")))).alias("gap")), "gaps")
    d = d.join(gaps, same(d, gaps)).select(d["*"], "gap")
    pool = F.col("rank").isNotNull() & (F.col("more") == 0) & (F.col("size") <= (2 * F.col("gap") if last else F.col("gap")))
    d = d.withColumn("bucket", F.when(pool, F.floor(F.col("rank") * BUCKETS).cast("int")))
    counted = d.where("bucket is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.max("gap").alias("gap"))
    counted = counted.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))
    cuts = counted.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("gap"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("before")))).alias("c"))
    cuts = stage(cuts.select("source", F.coalesce("c.bucket", F.lit(BUCKETS)).alias("cut"), F.coalesce("c.before", F.lit(0)).alias("before")), "cuts")
    d = d.join(cuts, same(d, cuts), "left").select(d["*"], "cut", "before")
    names = [c for c in d.columns if c not in ("gap", "bucket", "cut", "before", "more")]
    inside = F.col("bucket") == F.col("cut")
    rest = d.where(~F.coalesce(inside, F.lit(False))).select(*names, (F.col("more") + F.coalesce((F.col("bucket") < F.col("cut")).cast("long"), F.lit(0))).alias("more"))
    ordered = Window.partitionBy("source").orderBy("rank", "doc_id", "size", *numbers).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("before") + F.sum("size").over(ordered)
    drawn = d.where(inside).select(*names, (upto - (F.col("size") / 2 if last else F.lit(0)) <= F.col("gap")).cast("long").alias("more"))
    return rest.unionByName(drawn)
