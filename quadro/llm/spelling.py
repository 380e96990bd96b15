"""Groups of spelling variants: words that differ by one inserted, deleted or replaced letter.

Two such words share all but one letter of the longer one in a common prefix and a common
suffix together, so they share either the first or the last half of it. Words meet by that
half (and by length), and tasks compare the words of such a bucket as one dense tile of
padded code-point matrices. A bucket too large for a tile is split by halving what its words
don't share yet; at the last step one letter is left, so a bucket holds no more words than
there are letters. Every pair has one way down, so it is found once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadro.llm.common import stage, text_of

#: Letters of a word, and those whose case is folded.
LETTERS, UPPER, LOWER = r"A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The least code points and occurrences of a word; a form is so many times as frequent.
LENGTH, OCCURRENCES, TIMES = 7, 2, 10
#: One in so many runs of a document, by hash, loses a letter.
DROPPED = 31
#: Cells (words x words x length) of a tile.
TILE = 1 << 21
#: Over so many crowded buckets they are joined instead of broadcast.
BROADCAST = 1 << 17


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts with their occurrences, as the module's constants say."""
    run = F.explode(F.regexp_extract_all(text_of("text"), F.lit(f"[{LETTERS}]{{{LENGTH},}}"), F.lit(0)))  # shorter runs give no word
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), run.alias("run")).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.encode(F.concat("doc", F.lit(":"), "run"), "UTF-8"))
    at = F.col("h") % F.char_length("run")
    short = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.char_length("run")))
    d = d.select("run", h.alias("h")).select(F.when(F.col("h") % DROPPED == 0, short).otherwise(F.col("run")).alias("word"))
    return d.where(F.char_length("word") >= LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OCCURRENCES)


def _bucket() -> Column:
    """Of words of `size` letters, or one less, with the same first `head` and last `tail` letters,
    come to by the same way down. Buckets whose hashes are equal share tiles; the tile's own test
    keeps their pairs apart."""
    shared = F.substring("word", F.lit(1), F.col("head")), F.when(F.col("tail") > 0, F.right("word", F.col("tail"))).otherwise(F.lit(""))
    return F.xxhash64("size", "head", "tail", "bound", *shared)


def _halves(d: DataFrame) -> DataFrame:
    """Each word of a bucket (size, head, tail, bound) in the two that halve the rest of it. bound: pairs share a shorter prefix."""
    step = F.floor((F.col("size") - F.col("head") - F.col("tail")) / 2).cast("int")
    first = F.struct((F.col("head") + step).alias("head"), F.col("tail").alias("tail"), F.col("bound").alias("bound"))
    last = F.struct(F.col("head").alias("head"), (F.col("tail") + step).alias("tail"), (F.col("head") + step).alias("bound"))
    d = d.select("word", "n", "size", F.explode(F.array(first, last)).alias("at")).select("word", "n", "size", "at.*")
    return d.withColumn("bucket", _bucket())


def _padded(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' code points (all under 256) as rows padded at the end, and at the start."""
    flat = [t.encode("latin-1") for t in texts]
    left = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in flat), np.uint8).reshape(len(texts), width)
    right = np.frombuffer(b"".join(t.rjust(width, b"\0") for t in flat), np.uint8).reshape(len(texts), width)
    return left, right[:, ::-1]


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal letters at the start of each row of a (groups, m, width) and each of b, as (groups, m of a, m of b)."""
    differ = a[:, :, None, :] != b[:, None, :, :]
    return np.where(differ.any(-1), differ.argmax(-1), a.shape[-1])


def near_in(left: np.ndarray, right: np.ndarray, length: np.ndarray, size: int, head: int, tail: int, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, i, j) of near words i < j in tiles (groups, members, size); a length of 0 is no word."""
    found, per = [], max(1, TILE // (left.shape[1] * size))
    for g in range(0, len(left), max(1, per // left.shape[1])):
        for r in range(0, left.shape[1], per):
            rows, of = slice(r, r + per), slice(g, g + max(1, per // left.shape[1]))
            a, b = _shared(left[of, rows], left[of]), _shared(right[of, rows], right[of])
            n, m = length[of, rows, None], length[of, None, :]
            pairs = (a + b >= size - 1) & (a >= head) & (b >= tail) & (a < bound) & (n > 0) & (m > 0) & (np.maximum(n, m) == size)
            pairs &= np.arange(r, r + pairs.shape[1])[None, :, None] < np.arange(pairs.shape[2])
            k, i, j = np.nonzero(pairs)
            found.append((k + g, i + r, j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs (a, b: struct of word and n) of rows sorted by bucket; a bucket never waits for more than its own rows."""
    waiting: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = b.column("bucket").to_numpy()
        cut = int(np.searchsorted(key, key[-1], side="left")) if np.all(key[:-1] <= key[1:]) else 0
        if cut:
            yield from _pairs(pa.Table.from_batches([*waiting, b.slice(0, cut)]).combine_chunks())
            waiting = []
        waiting.append(b.slice(cut))
    if waiting:
        yield from _pairs(pa.Table.from_batches(waiting).combine_chunks())


def _pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    keys = np.column_stack([rows.column(c).to_numpy() for c in ("bucket", "size", "head", "tail", "bound")])
    start = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))
    count = np.diff(np.append(start, len(keys)))
    start, count = start[count > 1], count[count > 1]
    if not len(start):
        return
    words, n = rows.column("word").to_pylist(), rows.column("n").to_numpy()
    lengths = np.array([len(w) for w in words])
    kind = np.column_stack([keys[start, 1:], 1 << np.ceil(np.log2(count)).astype(int)])  # buckets that can be stacked
    order = np.lexsort(kind.T)
    edges = np.flatnonzero(np.append(True, (kind[order][1:] != kind[order][:-1]).any(1)))
    firsts, seconds = [], []
    for group in np.split(order, edges[1:]):
        size, head, tail, bound, members = kind[group[0]].tolist()
        for some in np.array_split(group, max(1, len(group) * members * size >> 21)):
            slot = start[some][:, None] + np.arange(members)
            real = np.arange(members) < count[some][:, None]
            slot = np.where(real, slot, start[some][:, None])
            left, right = _padded([words[i] for i in slot.ravel()], size)
            shape = (len(some), members, size)
            k, i, j = near_in(left.reshape(shape), right.reshape(shape), np.where(real, lengths[slot], 0), size, head, tail, bound)
            firsts.append(slot[k, i])
            seconds.append(slot[k, j])
    a, b = np.concatenate(firsts), np.concatenate(seconds)
    for x in range(0, len(a), 10_000):
        sides = [(rows.column("word").combine_chunks().take(pa.array(s)), pa.array(n[s])) for s in (a[x : x + 10_000], b[x : x + 10_000])]
        yield pa.RecordBatch.from_arrays([c for side in sides for c in side], ["word", "n", "near", "near_n"])


def near_pairs(found: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of near words of found (word, n; words distinct, of letters) once."""
    size, whole = F.char_length("word"), F.lit(1 << 30)
    root = found.select("word", "n", F.explode(F.array(size, size + 1)).alias("size")).withColumns({"head": F.lit(0), "tail": F.lit(0), "bound": whole})
    level, ready = _halves(root), None
    fits = F.col("rows") * F.col("rows") * F.col("size") <= TILE
    while True:
        crowded = level.where(F.col("size") - F.col("head") - F.col("tail") > 1).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.max("size").alias("size")).where(~fits).select("bucket")
        crowded = stage(crowded, "crowded")
        some = crowded.count()
        if not some:
            ready = level if ready is None else ready.unionByName(level)
            break
        few = F.broadcast(crowded) if some <= BROADCAST else crowded
        kept = level.join(few, "bucket", "left_anti")
        ready = kept if ready is None else ready.unionByName(kept)
        level = _halves(level.join(few, "bucket", "left_semi"))
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = ready.select("bucket", "size", "head", "tail", "bound", "word", "n").repartition(parts, "bucket").sortWithinPartitions("bucket", "size", "head", "tail", "bound")
    return d.mapInArrow(_tiles, "word string, n bigint, near string, near_n bigint")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs (doc_id, text).

    A word's form is its most frequent near word (of equally frequent ones the first in
    code-point order) if that is at least TIMES as frequent, else null; its root is the end of
    the forms from it, itself without one. Null and empty texts have no words; a null doc_id
    counts as an empty one. Rows that repeat are counted as often as they occur. Without words
    there are no rows. Other columns are ignored.
    """
    found = stage(words(docs), "words")
    pairs = stage(near_pairs(found), "pairs")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    d = found.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (-F.col("best.less")).alias("near_n"), "best.near")
    d = stage(d.select("word", "n", "n_near", *[F.when(F.col("near_n") >= TIMES * F.col("n"), F.col(c)).alias(a) for c, a in (("near", "form"), ("near_n", "form_n"))]), "forms")
    ends = stage(d.where("form is not null").select("word", F.col("form").alias("root")), "ends")
    while True:  # forms grow tenfold, so their chains end, and each round doubles the steps
        further = ends.join(ends.select(F.col("word").alias("root"), F.col("root").alias("end")), "root", "left")
        if further.where("end is not null").isEmpty():
            break
        ends = stage(further.select("word", F.coalesce("end", "root").alias("root")), "ends")
    return d.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
