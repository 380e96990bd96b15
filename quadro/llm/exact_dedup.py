"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

1. Each normalised text is cut where its own content says so: a chunk runs to the
   first sentence end after MIN_CHARS characters, or to MAX_CHARS where there is none.
2. Chunks are deduplicated to verified identifiers. The identifier is a 64-bit hash;
   every distinct chunk is moved once, copies being combined before the shuffle, and
   a hash that stands for more than one content gets an ordinal per content.
3. A document becomes its recipe, the ordered list of identifiers. Only recipes are
   grouped and joined afterwards; no text moves again.

Equal recipes mean equal chunk lists, hence equal normalised texts, and the reverse.

Defined cases: a null text counts as empty; all empty texts are one group; rows that
repeat a doc_id count as the same document (each is returned, with the same keep_id,
and group_size counts rows); a null doc_id never wins against another id; an empty
table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadro.llm.common import SPACE, stage, text_of

MIN_CHARS, MAX_CHARS = 512, 4096
CHUNK = rf"(?s).{{{MIN_CHARS},{MAX_CHARS - 2}}}?[.!?]\x20|.{{1,{MAX_CHARS}}}"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), SPACE, " ")


def chunks(norm: Column) -> Column:
    return F.regexp_extract_all(norm, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, recipe (chunk identifiers in order), fixes (position and ordinal of the
    chunks whose hash is shared by different contents, else null), text_sha256.

    identify: hash of a chunk; a weak one only makes more fixes.
    """
    norm = docs.select("doc_id", normalised("text").alias("norm"))
    base = stage(norm.select(
        "doc_id",
        F.transform(chunks(F.col("norm")), lambda c: identify(c)).alias("recipe"),
        F.sha2(F.col("norm"), 256).alias("text_sha256"),
    ), "recipes")
    contents = (
        norm.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
        .select(identify(F.col("chunk")).alias("h"), "chunk").distinct()
    )
    shared = stage(
        contents.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        .where("n > 1").select("h"), "shared-hashes")
    if shared.isEmpty():
        return base.withColumn("fixes", F.lit(None).cast("array<struct<pos:int,content:string>>"))
    # The hash doesn't tell these contents apart: the recipe names them by content.
    fixes = (
        norm.select("doc_id", F.sha2(F.col("norm"), 256).alias("text_sha256"), F.posexplode(chunks(F.col("norm"))).alias("pos", "content"))
        .withColumn("h", identify(F.col("content"))).join(shared, "h", "left_semi")
        .groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_set(F.struct("pos", "content"))).alias("fixes"))
    )
    return base.join(
        fixes.withColumnsRenamed({"doc_id": "d2", "text_sha256": "s2"}),
        F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_sha256") == F.col("s2")), "left",
    ).select(*base.columns, "fixes")


def exact_groups(docs: DataFrame, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    found = recipes(docs, identify)
    key = ["recipe", "fixes"]
    groups = found.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.withColumnsRenamed({k: f"g_{k}" for k in key})
    joined = found.join(groups, (F.col("recipe") == F.col("g_recipe")) & F.col("fixes").eqNullSafe(F.col("g_fixes")))
    return joined.select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
    )
