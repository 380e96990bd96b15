"""Removal of repeated passages with a sampled, range-partitioned suffix array.

A byte goes if a SPAN-byte string over it also starts in a document with a smaller id.

Sorting the suffixes of every byte would move the corpus many times over. Instead the
array holds the suffixes at anchors: positions whose LEAD-byte string has the smallest
hash in some SPAN-byte string (winnowing). Equal SPAN-byte strings have their anchors at
equal places, so every repeated one meets its copies in the array.

1. Suffixes are range-partitioned by their leading bytes with sampled splitters. The
   sort key goes on with the bytes around the anchor (all that the SPAN-byte strings
   over it hold), the document and the position, so a passage that a third of all
   documents share is split over many buckets, too. Buckets sort locally by multikey
   quicksort: by leading bytes, then only the runs of equal ones by the next key.
2. Neighbours that are equal around the anchor decide all strings over it at once: the
   first document keeps, the others are covered. Where a run of equal leading bytes has
   different surroundings, or touches a bucket's boundary, it is left open.
3. The SPAN-byte strings at open anchors are range-partitioned and sorted in the same
   way; a bucket's first run is compared with the runs that end earlier buckets.
4. Documents are joined with what is covered in them, and cut.

Strings are compared by 128 bits of hashes; texts move in steps 3 and 4 only, once each.

Defined cases: a null text is empty; texts shorter than SPAN bytes lose nothing; equal
strings within one document don't count, nor do those of rows with the same doc_id; a
row without doc_id loses nothing and takes nothing from others; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadro.llm.common import stage, text_of
from quadro.llm.shingles import _BASE, _BYTE, buffers, mix, slices

SPAN, LEAD = 50, 24
#: Positions that a SPAN-byte string offers to an anchor.
OFFERS = SPAN - LEAD + 1
#: One document in SAMPLE gives splitters, OVER candidates for each bucket.
SAMPLE, OVER = 16, 64
#: Of a position that is stored with a tag of its text (for rows that share a doc_id).
TAG = 1 << 38
_BYTES = _BYTE.copy()
_BYTES[65:91] = _BYTE[65:91] * np.uint64(31)  # case counts
_BACK = pow(int(_BASE), -1, 1 << 64)
#: Rows of both kinds of suffixes. high and low: the hashes by which they are sorted.
SUFFIX = T.StructType([T.StructField("high", T.LongType()), T.StructField("low", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("at", T.LongType())])


class _Prefix:
    """Hashes of any part of one text, from sums over its beginnings."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * np.cumprod(np.full(n, _BASE)), out=self.sums[1:])
        self.back = np.cumprod(np.full(n + 1, np.uint64(_BACK)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]

    def every(self, size: int) -> np.ndarray:
        return mix((self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size])


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of each `width` neighbours, by doubling."""
    f, have = (np.minimum if least else np.maximum), 1
    while have < width:
        step = min(have, width - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def anchors(grams: np.ndarray) -> np.ndarray:
    """Positions that are smallest in some OFFERS neighbours."""
    if len(grams) < OFFERS:
        return np.zeros(0, np.int64)
    least = _sliding(grams, OFFERS, True)
    pad = np.zeros(OFFERS - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), OFFERS, False) == grams)


def _suffixes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leading bytes and hash of the string at the anchor, hash of its surroundings, anchor)."""
    n = len(data)
    prefix = _Prefix(data)
    grams = prefix.every(LEAD)
    at = anchors(grams)
    lead = np.zeros(len(at), np.uint64)
    for k in range(3):
        lead = lead << np.uint64(8) | data[at + k]
    # The leading bytes come first in order; the top bit is left to the sign.
    high = (lead << np.uint64(39) | grams[at] >> np.uint64(25)).astype(np.int64)
    start, end = np.maximum(at - (OFFERS - 1), 0), np.minimum(at + SPAN, n)
    around = mix(prefix.of(start, end) + mix((at - start).astype(np.uint64) * np.uint64(64) + (end - at).astype(np.uint64)))
    return high, around.view(np.int64), at


def with_tags(docs: DataFrame) -> DataFrame:
    """doc_id, text, tag. Only where a doc_id repeats do tags tell its texts apart."""
    text = text_of("text")
    repeats = not docs.groupBy("doc_id").count().where("count > 1").isEmpty()
    tag = F.xxhash64(text).bitwiseAND((1 << 24) - 1) if repeats else F.lit(0).cast("long")
    return docs.select("doc_id", text.alias("text"), tag.alias("tag"))


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "tag", "text")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(batch, row, bytes) of every text of at least SPAN bytes."""
    for b in slices(batches):
        data, offsets = buffers(b.column("text"))
        for i in np.flatnonzero(np.diff(offsets) >= SPAN).tolist():
            yield b, i, data[offsets[i] : offsets[i + 1]]


def _batch(rows: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=names)


def _in_batches(parts: Iterator[tuple[np.ndarray, ...]], names: list[str], most: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    rows, n = [], 0
    for part in parts:
        rows.append(part)
        n += len(part[0])
        if n >= most:
            yield _batch(rows, names)
            rows, n = [], 0
    if n:
        yield _batch(rows, names)


def anchor_suffixes(docs: DataFrame) -> DataFrame:
    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for b, i, data in _pieces(batches):
                high, low, at = _suffixes(data)
                tag = b.column("tag")[i].as_py() * TAG
                yield high, low, np.full(len(at), b.column("doc_id")[i].as_py(), np.int64), at + tag

        return _in_batches(parts(), SUFFIX.names)

    return _numbered(docs).mapInArrow(one, SUFFIX)


def multikey_order(high: np.ndarray, low: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Order by the first key; then the runs of equal ones by the next two."""
    order = np.argsort(high)
    first = high[order]
    same = np.append(False, first[1:] == first[:-1])
    run = same | np.append(same[1:], False)
    inner = order[run]
    # Runs keep their places: they are sorted by the first key already.
    order[run] = inner[np.lexsort((doc[inner], low[inner], high[inner]))]
    return order


def _sorted_bucket(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray] | None:
    """The columns of a bucket, in order. Splitters keep every bucket small: the sort key
    ends in document and position, so no key is too frequent to be split."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None
    columns = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in SUFFIX.names]
    order = multikey_order(*columns[:3])
    return [c[order] for c in columns]


def _split(docs: DataFrame, suffixes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The suffixes of docs, one range of the sort order in each partition.

    Splitters come from the suffixes of one document in SAMPLE (a draw of OVER for each
    bucket). Spark's own range partitioning would make all suffixes twice.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = suffixes(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0))
    drawn = some.orderBy(F.xxhash64(*SUFFIX.names)).limit(OVER * n).collect()  # bounded
    drawn = sorted(map(tuple, drawn))
    splitters = [drawn[k * len(drawn) // n] for k in range(1, n)] if drawn else []
    # A number for each partition that Spark's hash partitioning sends there.
    own = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    to = np.zeros(n, np.int64)
    for r in own:
        to[r["p"]] = r["id"]
    highs = np.array([x[0] for x in splitters], np.int64)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_numpy() for c in SUFFIX.names]
            bucket = np.searchsorted(highs, columns[0], "left")
            tied = np.flatnonzero(bucket < np.searchsorted(highs, columns[0], "right"))
            for k in np.unique(bucket[tied]).tolist():  # a splitter has this first key: compare the others
                rows = tied[bucket[tied] == k]
                at = k
                while at < len(splitters) and splitters[at][0] == splitters[k][0]:
                    _, low, doc, place = splitters[at]
                    c1, c2, c3 = (columns[j][rows] for j in (1, 2, 3))
                    bucket[rows] += (c1 > low) | (c1 == low) & ((c2 > doc) | (c2 == doc) & (c3 >= place))
                    at += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to[bucket])], names=[*SUFFIX.names, "bucket"])

    dealt = suffixes(docs).mapInArrow(one, T.StructType([*SUFFIX.fields, T.StructField("bucket", T.LongType())]))
    return dealt.repartition(n, "bucket").select(*SUFFIX.names)


COVERED, OPEN, PENDING, LAST = 0, 1, 2, 3


def compare_anchors(docs: DataFrame) -> DataFrame:
    """doc, at, what: anchors that are covered (by a smaller document with the same
    surroundings) or open. Others, the most of them, are left out."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _sorted_bucket(batches)
        if bucket is None:
            return
        high, low, doc, at = bucket
        new_run = np.append(True, high[1:] != high[:-1])
        new_group = new_run | np.append(True, low[1:] != low[:-1])
        group = np.cumsum(new_group) - 1
        covered = doc > doc[np.flatnonzero(new_group)][group]
        run = np.cumsum(new_run) - 1
        starts = np.flatnonzero(new_run)
        several = np.add.reduceat(new_group.astype(np.int64), starts) > 1
        several &= np.minimum.reduceat(doc, starts) < np.maximum.reduceat(doc, starts)
        several[[0, -1]] = True  # it may go on in the next bucket
        chosen = np.flatnonzero(covered | several[run])
        what = np.where(covered, COVERED, OPEN)[chosen].astype(np.int8)
        for a in range(0, len(chosen), 1 << 16):
            k = chosen[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(at[k]), pa.array(what[a : a + (1 << 16)])], names=["doc", "at", "what"])

    return _split(docs, anchor_suffixes).mapInArrow(one, "doc long, at long, what byte")


def compare_strings(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc, at: strings that a smaller document holds, too."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _sorted_bucket(batches)
        if bucket is None:
            return
        high, low, doc, at = bucket
        new = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        first = doc[starts][run]
        what = np.where(doc > first, COVERED, OPEN)
        # The first run may have begun, and the last may go on, in other buckets.
        what[(run == 0) & (what == OPEN)] = PENDING
        chosen = np.flatnonzero(what != OPEN)
        rows = [high[chosen], low[chosen], doc[chosen], at[chosen], what[chosen].astype(np.int8)]
        rows = [np.append(c, x).astype(c.dtype) for c, x in zip(rows, (high[-1], low[-1], first[-1], at[-1], LAST), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows], names=[*SUFFIX.names, "what"])

    found = stage(_split(docs, lambda d: open_strings(d, found)).mapInArrow(one, T.StructType([*SUFFIX.fields, T.StructField("what", T.ByteType())])), "strings")
    # A smaller document in the last run of an earlier bucket: one row a bucket to look at, and
    # so a broadcast of 24 bytes for each bucket at most.
    ends = found.where(F.col("what") == LAST).groupBy("high", "low").agg(F.min("doc").alias("least"))
    pending = found.where(F.col("what") == PENDING).join(F.broadcast(ends), ["high", "low"]).where("least < doc")
    return found.where(F.col("what") == COVERED).select("doc", "at").unionByName(pending.select("doc", "at"))


def _with_text(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, tag, text, and the places of `found` (doc, at, size) in it."""
    tag, at = F.floor(F.col("at") / F.lit(TAG)), F.pmod("at", F.lit(TAG))
    listed = found.groupBy(F.col("doc").alias("d2"), tag.alias("t2")).agg(F.collect_list(at).alias("at"), F.collect_list("size").alias("size"))
    d = _numbered(docs)
    return d.join(listed, (d["doc_id"] == listed["d2"]) & (d["tag"] == listed["t2"])).select("doc_id", "tag", "text", "at", "size")


def open_strings(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The SPAN-byte strings whose anchor is open."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts():
            for b, i, data in _pieces(batches):
                prefix = _Prefix(data)
                grams = prefix.every(LEAD)
                only = np.full(len(grams), 2**64 - 1, np.uint64)
                at = b.column("at")[i].values.to_numpy()
                only[at] = grams[at]
                start = np.flatnonzero(_sliding(only, OFFERS, True) == _sliding(grams, OFFERS, True))
                raw = prefix.of(start, start + SPAN)
                half = prefix.of(start, start + SPAN // 2)  # more bits: a string and its first half
                yield mix(raw.copy()).view(np.int64), mix(half ^ raw * np.uint64(31)).view(np.int64), np.full(len(start), b.column("doc_id")[i].as_py(), np.int64), start + b.column("tag")[i].as_py() * TAG

        return _in_batches(parts(), SUFFIX.names)

    return _with_text(docs, found.select("doc", "at", F.lit(0).alias("size"))).mapInArrow(one, SUFFIX)


def repeated(docs: DataFrame) -> DataFrame:
    """doc, at, size: what is covered. size 0: an anchor, and all strings over it. docs: with_tags()."""
    compared = stage(compare_anchors(docs), "anchors")
    strings = compare_strings(docs, compared.where(F.col("what") == OPEN))
    covered = compared.where(F.col("what") == COVERED).select("doc", "at", F.lit(0).alias("size"))
    return stage(covered.unionByName(strings.select("doc", "at", F.lit(SPAN).alias("size"))), "covered")


def removed_runs(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Start and end of the maximal covered runs of bytes."""
    start = np.where(size > 0, at, np.maximum(at - (OFFERS - 1), 0))
    end = np.where(size > 0, at + size, np.minimum(at, len(data) - SPAN) + SPAN)
    mark = np.zeros(len(data) + 2, np.int64)
    np.add.at(mark, start + 1, 1)
    np.add.at(mark, end + 1, -1)
    inside = np.cumsum(mark) > 0
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, runs (array of start and end in bytes), n_bytes, n_removed, kept (the bytes
    left): one row for each row of docs."""
    kind, docs = docs.schema["doc_id"], with_tags(docs)
    found = repeated(docs)
    tag, at = F.floor(F.col("at") / F.lit(TAG)), F.pmod("at", F.lit(TAG))
    listed = found.groupBy(F.col("doc").alias("d2"), tag.alias("t2")).agg(F.collect_list(at).alias("at"), F.collect_list("size").alias("size"))
    d = docs.join(listed, (docs["doc_id"].cast("long") == listed["d2"]) & (docs["tag"] == listed["t2"]), "left").select("doc_id", "text", "at", "size")
    schema = T.StructType([kind, T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, offsets = buffers(b.column("text"))
            runs, sizes, gone, kept = [], [], [], []
            for i in range(b.num_rows):
                own = data[offsets[i] : offsets[i + 1]]
                found = np.zeros((0, 2), np.int64)
                if b.column("at")[i].is_valid:
                    found = removed_runs(own, b.column("at")[i].values.to_numpy(), b.column("size")[i].values.to_numpy())
                ends = np.concatenate([[0], found.reshape(-1), [len(own)]]).reshape(-1, 2)
                runs.append(found.tolist())
                sizes.append(len(own))
                gone.append(int((found[:, 1] - found[:, 0]).sum()))
                kept.append(b"".join(own[a:z].tobytes() for a, z in ends.tolist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], names=schema.names)

    return d.mapInArrow(one, schema)
