"""Near-duplicate groups by MinHash with tensored banding.

Texts become sets of word shingles. Equal sets are one class, represented by their
smallest doc_id. Two collections of SIDE half-bands of ROWS minhashes each are computed;
a table key is a pair of half-bands, one of each collection, so 2 * SIDE * ROWS minhashes
serve SIDE * SIDE tables (256 tables of 8 rows from 128 minhashes instead of 2,048).

Half-bands are counted first. A pair that shares a key shares a half-band on both
sides, so documents without a shared one on either side have no candidates and emit no
table keys; the others only combine their shared half-bands.

Candidates are verified on the full sets, in two rounds:
1. In each table bucket every member is paired with one of them, its hub: the member that
   shares most buckets with most others, so the text that a family of copies was made from
   rather than one of the copies. Each document is compared with its best-looking hubs.
   Confirmed links give first components.
2. Members of buckets that still hold several components are compared across components
   by an exact join on their rarest shingles (_across), so a passage that a third of all
   documents share doesn't pair them all.
Members of one component are never paired again, so a group of thousands of near copies
costs a few comparisons for each member, and no link that would join two components is
left out. A pair is compared in full only if its signatures agree in at least
LEAST_AGREE of 128 minhashes; at similarity 0.8 fewer agree in about one pair of 10^8.

Two documents of similarity 0.8 share a table but for 1 pair in 2,200 (at 0.85: 1 in
60,000; at 0.9: 1 in 10^7).

Defined cases: a null text is empty; a text without words has an empty set and links
with nothing; rows that repeat a doc_id are one node with all their texts; a row
without doc_id links with nothing and is kept; an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadro.llm.common import SHORT_BATCHES, stage
from quadro.llm.components import components
from quadro.llm.shingles import digest, mix, shingle_sets, slices

SIDE, ROWS, PERCENT, LEAST_AGREE = 16, 4, 80, 74
#: Hubs that a document is compared with first; round 2 takes care of the others.
FIRST = 3
#: Shingles hashed at a time: they stay in the processor's cache.
BLOCK = 1 << 15
#: Shingles that are ordered last, found in one node of SAMPLE.
COMMON, SAMPLE = 1 << 16, 8


def signatures(sets: list[np.ndarray], hashes: int = 2 * SIDE * ROWS) -> np.ndarray:
    """A row of minhashes for each non-empty set."""
    rng = np.random.Generator(np.random.PCG64(11))
    flip, by = (rng.integers(0, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    out = np.empty((len(sets), hashes), np.uint64)
    i = 0
    while i < len(sets):
        j, n = i, 0
        while j < len(sets) and (j == i or n + len(sets[j]) <= BLOCK):
            n, j = n + len(sets[j]), j + 1
        flat = np.concatenate(sets[i:j])
        at = np.cumsum([0, *map(len, sets[i : j - 1])])
        for k in range(hashes):
            out[i:j, k] = np.minimum.reduceat((flat ^ flip[k]) * by[k], at)
        i = j
    return out


def half_bands(sig: np.ndarray) -> np.ndarray:
    """2 * SIDE hashes of ROWS minhashes each, a row for each signature."""
    out = np.zeros((len(sig), 2 * SIDE), np.uint64)
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, r :: ROWS])
    return mix(out + np.arange(2 * SIDE, dtype=np.uint64))


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, digest, bands (2 * SIDE longs), sig (128 16-bit minhashes): a row for each row of docs."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands, short = np.zeros((len(sets), 2 * SIDE), np.int64), [None] * len(sets)
            if full:
                sig = signatures([sets[i] for i in full])
                bands[full] = half_bands(sig).view(np.int64)
                for i, s in zip(full, (sig >> np.uint64(48)).astype(np.uint16), strict=True):
                    short[i] = s.tobytes()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, 2 * SIDE, dtype=np.int32)), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), lists, pa.array(short, pa.binary())],
                names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(one, schema)


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (u, v, ...) those whose signatures agree well enough, with `agree`."""
    sig = nodes.select("node", "sig")
    d = pairs.join(sig.withColumnsRenamed({"node": "v", "sig": "sig_v"}), "v")
    d = d.join(sig.withColumnsRenamed({"node": "u", "sig": "sig_u"}), "u")
    schema = T.StructType([T.StructField("u", pairs.schema["u"].dataType), T.StructField("v", pairs.schema["v"].dataType), T.StructField("agree", T.IntegerType())])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(b.num_rows, -1) for c in ("sig_u", "sig_v"))
            n = (a == z).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(n)], names=schema.names).filter(pa.array(n >= LEAST_AGREE))

    return d.select("u", "v", "sig_u", "sig_v").mapInArrow(one, schema)


def _sets_of(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """node, found (its sorted shingle hashes) for the nodes given."""
    kind = docs.schema["doc_id"].dataType
    wanted = docs.select("doc_id", "text").join(nodes.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), width)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "found"])

    return wanted.mapInArrow(one, T.StructType([T.StructField("node", kind), T.StructField("found", T.BinaryType())]))


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Of pairs (u, v) those that are similar on their full sets."""
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = stage(_sets_of(docs, nodes, width), "sets", SHORT_BATCHES)
    d = pairs.join(sets.withColumnsRenamed({"node": "v", "found": "set_v"}), "v")
    d = d.join(sets.withColumnsRenamed({"node": "u", "found": "set_u"}), "u").select("u", "v", "set_u", "set_v")

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column("set_u"), b.column("set_v"), strict=True):
                p, q = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(len(p) > 0 and 100 * common >= PERCENT * (len(both) - common))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return d.mapInArrow(one, pairs.select("u", "v").schema)


def _common_shingles(docs: DataFrame, nodes: DataFrame, width: int) -> np.ndarray:
    """The COMMON most frequent shingles of one node in SAMPLE (a bounded collect). They
    only order tokens: any order is exact, one with rare shingles first is fast."""
    some = _sets_of(docs, nodes.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0).select("node"), width)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "found"):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(b.column("found").to_pylist()), np.int64))], names=["token"])

    counts = some.mapInArrow(one, "token long").groupBy("token").agg(F.count(F.lit(1)).alias("times")).where("times > 2")
    return np.sort(np.array([r[0] for r in counts.orderBy(F.desc("times"), "token").limit(COMMON).select("token").collect()], np.int64).view(np.uint64))


def _across(docs: DataFrame, several: DataFrame, width: int) -> DataFrame:
    """Pairs (u, v) of nodes of different components that may be similar: an exact join.

    A set's tokens are ordered, rare ones first. Of two sets of similarity 0.8 the larger has a
    shared token among its first fifth (more exactly the first n - ceil(0.8 n) + 1), the other,
    since they share at least 16/18 of its size, among its first ninth (n - ceil(8 n / 9) + 1).
    So only the first ninths are joined to first fifths of sets as large or larger: documents
    of one template that differ in more than a ninth have no pairs to compare at all, however
    many they are. The place of a shared token also bounds how many they can share.
    """
    kind = several.schema["node"].dataType
    common = several.sparkSession.sparkContext.broadcast(_common_shingles(docs, several, width))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "found"):
            tokens, rows, places, sizes = [], [], [], []
            for i, x in enumerate(b.column("found")):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                often = common.value[np.minimum(np.searchsorted(common.value, s), len(common.value) - 1)] == s if len(common.value) else np.zeros(len(s), bool)
                first = np.concatenate([s[~often], s[often]])[: len(s) - (len(s) * PERCENT + 99) // 100 + 1]
                tokens.append(first)
                rows.append(np.full(len(first), i))
                places.append(np.arange(len(first), dtype=np.int32))
                sizes.append(np.full(len(first), len(s), np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(places)), pa.array(np.concatenate(sizes))], names=["node", "token", "place", "n"])

    tokens = _sets_of(docs, several.select("node"), width).mapInArrow(one, T.StructType([T.StructField("node", kind), T.StructField("token", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("n", T.IntegerType())]))
    tokens = stage(tokens.join(several, "node"), "tokens", SHORT_BATCHES)
    shared = tokens.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token")
    tokens = tokens.join(shared, "token")
    ninth = F.col("n") - F.ceil(F.col("n") * 2 * PERCENT / (100 + PERCENT)) + 1
    other = tokens.where(F.col("place") < ninth).select("token", *[F.col(c).alias(f"{c}2") for c in ("node", "place", "n", "root")])
    most = 1 + F.least(F.col("n") - 1 - F.col("place"), F.col("n2") - 1 - F.col("place2"))
    larger = (F.col("n") > F.col("n2")) | (F.col("n") == F.col("n2")) & (F.col("node") > F.col("node2"))
    pairs = tokens.join(other, "token").where(larger & (F.col("root") != F.col("root2"))).where(most * (100 + PERCENT) >= PERCENT * (F.col("n") + F.col("n2")))
    return pairs.select(F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v")).distinct()


def near_groups(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    prof = stage(profiles(docs, width), "profiles", SHORT_BATCHES)
    classes = prof.where("n > 0 and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = stage(classes, "classes")
    nodes = classes.select("node", "n", "sig")

    halves = classes.select("node", "n", F.posexplode("bands").alias("i", "h"))
    often = halves.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("h")
    side = lambda s: F.collect_list(F.when((F.col("i") < SIDE) == F.lit(s), F.col("h")))
    lively = halves.join(often, "h").groupBy("node", "n").agg(side(True).alias("a"), side(False).alias("b")).where("size(a) > 0 and size(b) > 0")
    keys = lively.select("node", "n", F.explode("a").alias("a"), "b").select("node", "n", "a", F.explode("b").alias("b"))
    keys = stage(keys.select("node", "n", F.xxhash64("a", "b").alias("key")), "keys")
    shared = stage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "shared-keys")
    keys = stage(keys.join(shared, "key"), "keys")
    known = keys.groupBy("node").agg((-F.sum("members")).alias("known"))
    hubs = keys.join(known, "node").groupBy("key").agg(F.min(F.struct("known", "node", "n")).alias("hub"))
    buckets = keys.join(stage(hubs.select("key", "hub"), "hubs"), "key")
    near = lambda n, m: F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT

    stars = buckets.where(F.col("node") != F.col("hub.node")).where(near(F.col("n"), F.col("hub.n")))
    stars = stage(_agreeing(stars.select(F.col("hub.node").alias("u"), F.col("node").alias("v")).distinct(), nodes), "stars", SHORT_BATCHES)
    place = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("agree"), "u"))
    best = stars.withColumn("place", place).where(F.col("place") <= FIRST).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    first = stage(_confirmed(best, docs, width), "confirmed", SHORT_BATCHES)
    roots = components(first)

    labels = lambda d, c, name: d.join(roots.select(F.col("node").alias(c), F.col("root").alias(name)), c, "left").withColumn(name, F.coalesce(name, c))
    named = stage(labels(buckets.select("key", "node", "n"), "node", "root"), "named")
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    several = stage(named.join(mixed, "key", "left_semi").select("node", "root").distinct(), "several")
    across = _across(docs, several, width).join(best, ["u", "v"], "left_anti")
    second = stage(_confirmed(stage(_agreeing(across, nodes), "across", SHORT_BATCHES).select("u", "v"), docs, width), "confirmed", SHORT_BATCHES)
    if not second.isEmpty():
        roots = components(first.unionByName(second))

    members = prof.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(classes.select("digest", "node"), "digest", "left")
    members = members.join(roots, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "node", "doc_id"))
    return members.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
