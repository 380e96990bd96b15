"""A corpus from raw documents to piece ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it
kept; run() writes every stage's rows as Parquet and rereads them as the next one's
docs. All but the last return the columns of documents. Stages that select rows number
and write them first, so rows that repeat a doc_id or have none are told apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadro.llm import exact_dedup, minhash, mixing, pieces, quality
from quadro.llm.common import stage, table
from quadro.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _free(docs: DataFrame, name: str) -> str:
    """A column's name that docs doesn't have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written (a plan run again may number otherwise), and that column's name."""
    row = _free(docs, "_row")
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def _firsts(rows: DataFrame, row: str, groups: DataFrame, group: str) -> DataFrame:
    """Of each group (its doc_id being a row's number) the row with the smallest doc_id, null last."""
    d = groups.select(F.col("doc_id").alias("_number"), F.col(group).alias("_group")).join(rows.select(F.col(row).alias("_number"), F.col("doc_id").alias("_id")), "_number")
    first = d.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_number")).alias("first"))
    return rows.join(first.select(F.col("first._number").alias(row)), row, "left_semi").drop(row)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id."""
    rows, row = _numbered(docs)
    return _firsts(rows, row, exact_dedup.exact_groups(rows.select(F.col(row).alias("doc_id"), "text")), "keep_id")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity 0.8."""
    rows, row = _numbered(docs)
    return _firsts(rows, row, minhash.near_groups(rows.select(F.col(row).alias("doc_id"), "text")), "component_id")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rows, row = _numbered(docs)
    each = _free(docs, "_copies")
    copies = mixing.mix(rows.select(F.col(row).alias("_number"), "doc_id", "text", "source"), row="_number").where("copies > 0").select(F.col("_number").alias(row), F.sequence(F.lit(1).cast("long"), F.col("copies")).alias(each))
    return rows.join(copies, row).withColumn(each, F.explode(each)).drop(row, each)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip of every row."""
    d = pieces.encode(docs, vocabulary())
    return d.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.col("same").alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("exact_dedup", distinct_texts),
    ("near_dedup", no_near_copies),
    ("source_mix", mixed_sources),
    ("piece_encoding", piece_ids),
]

#: SQL can't express the classifier, MinHash or the hashed draw: tests/llm compares each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
