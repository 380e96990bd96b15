"""SentencePiece encoding and decoding over a relational lattice.

A text gets the library's normalisation of such files (a space before it, spaces as the
space symbol) and is cut into units that no piece crosses: a run of spaces with the
characters after it, or one control character; a word also ends at the punctuation that
no piece of the file joins to a letter or digit. Encoding has three steps:

1. Lattice. All distinct units are counted; their substrings, as long as the vocabulary's
   longest piece, are exploded and equi-joined to the piece table (a broadcast: a vocabulary file has a
   fixed size). Matches are edges; characters without a piece get a byte-fallback edge.
   Edges are grouped by unit; the units are partitioned already, so none of this moves.
2. Fold by Spark's higher-order `aggregate` over a unit's edges.
   - Unigram files: Viterbi, the path of the best score (ties: the longer last piece).
   - BPE files: a path of the best score is not what such a file means (it agrees with
     the library on 39 % of distinct words of the test corpus, 68 % with the best
     rescoring), so edges are folded in merge order instead: an edge joins two
     neighbours if exactly one boundary lies inside it. Boundaries are bits of a long.
     This equals the library on every word tried (see tests and README).
   Units of over LONGEST characters are folded the same way in an Arrow function.
3. Application. The most frequent units (HOT at most, of at most SHORT bytes: a table of
   fixed size) go to every task and are compared byte by byte; every other occurrence is
   joined to the encoded units by a shuffle, and put back into the text's pieces. Texts
   move once, as numbers of their units.

Defined cases: null and empty texts have no pieces; the space symbol itself counts as a
space, as in the library; texts of any length are encoded whole; repeated rows are
encoded each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadro.llm.common import SHORT_BATCHES, stage, text_of
from quadro.llm.shingles import _BASE, buffers, mix, slices

# Ranks are stored in three bytes: HOT stays below 2^24. SHORT bytes are two words.
HOT, SHORT, LONGEST = 1 << 19, 16, 62
#: Distinct units that a task gathers before it hands them on.
GATHERED = 1 << 19
#: Units that a task groups in memory before it sorts (Spark's default, 128, always sorts).
IN_MEMORY_GROUPS, GROUPS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", 150_000
SYMBOL = "▁"
#: Letters and digits of words (in UTF-8 the bytes of a-z, or a lead byte C3 to C9 and another).
LETTER = "A-Za-z0-9\u00C0-\u027F"


@dataclass
class Vocabulary:
    """Pieces with spaces as spaces, and the kind of file."""

    pieces: list[tuple[str, int, float]]  # text, id, score
    shown: list[bytes]  # what each id stands for in a text
    first_byte: int  # id of byte 0
    unigram: bool = False
    safe: str = ""  # ASCII punctuation that no piece has next to a letter or digit

    @property
    def widest(self) -> int:
        """Characters of the longest piece."""
        return max((len(p) for p, *_ in self.pieces), default=1)

    def frame(self, spark: SparkSession) -> DataFrame:
        """piece, rank (0 is merged first, or scores best), id, score."""
        if len(self.pieces) >= 1 << 20 or max((i for _, i, _ in self.pieces), default=0) + len(self.shown) >= UNKNOWN:
            raise ValueError("a vocabulary has less than 2^20 pieces")  # an edge holds no more
        order = sorted(self.pieces, key=lambda p: (-p[2], p[1]))
        return spark.createDataFrame([(p, r, i, float(s)) for r, (p, i, s) in enumerate(order)], "piece string, rank long, id long, score double")


def load(path: str, unigram: bool = False) -> Vocabulary:
    """Reads a SentencePiece model file with byte fallback."""
    import sentencepiece

    return from_processor(sentencepiece.SentencePieceProcessor(model_file=path), unigram)


def from_processor(sp, unigram: bool = False) -> Vocabulary:
    pieces, shown, first = [], [], 0
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            first = i if piece == "<0x00>" else first
            shown.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            shown.append(b"")
        else:
            pieces.append((piece.replace(SYMBOL, " "), i, sp.get_score(i)))
            shown.append(pieces[-1][0].encode())
    letter = re.compile(f"[{LETTER}]")
    met = {c for p, _, _ in pieces for a, b in zip(p, p[1:], strict=False) for c, d in ((a, b), (b, a)) if letter.match(d)}
    return Vocabulary(pieces, shown, first, unigram, "".join(c for c in string.punctuation if c not in met))


def prepared(text: str | Column) -> Column:
    t = F.replace(text_of(text), F.lit(SYMBOL), F.lit(" "))
    return F.when(t == "", t).otherwise(F.concat(F.lit(" "), t))


# An edge is one long: rank (20 bits), start (6), size (6), value (22). The value is a
# piece id, or for a character without a piece UNKNOWN plus its code point.
UNKNOWN = 1 << 21


def _edges(units: DataFrame, pieces: DataFrame, scored: bool, widest: int) -> DataFrame:
    """unit, n, edges (longs, or structs of `at` and `score`): the lattice of every unit."""
    size = F.length("unit")
    d = units.select("unit", "n", F.explode(F.sequence(F.lit(1), size)).alias("s"))
    d = d.select("unit", "n", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(widest), size - F.col("s") + 1))).alias("k"))
    d = d.withColumn("part", F.substring("unit", F.col("s"), F.col("k"))).withColumn("h", F.xxhash64("part"))
    # Joined by the hash as a number, several times as fast; the texts decide.
    same = (F.col("part") <= F.col("piece")) & (F.col("part") >= F.col("piece"))
    d = d.join(F.broadcast(pieces.withColumn("key", F.xxhash64("piece"))), (F.col("h") == F.col("key")) & same, "left").where("id is not null or k = 1")
    value = F.coalesce("id", F.lit(UNKNOWN) + F.ascii("part"))
    packed = (F.shiftleft(F.coalesce("rank", F.lit((1 << 20) - 1).cast("long")), 34)
              + F.shiftleft((F.col("s") - 1).cast("long"), 28) + F.shiftleft(F.col("k").cast("long"), 22) + value)
    if scored:
        # A character without a piece costs more than any way around it.
        edge = F.struct(packed.alias("at"), F.coalesce("score", F.lit(-1e6)).alias("score"))
        return d.groupBy("unit", "n").agg(F.collect_list(edge).alias("edges"))
    return d.groupBy("unit", "n").agg(F.collect_list(F.when(F.col("k") > 1, packed)).alias("edges"), F.collect_list(F.when(F.col("k") == 1, packed)).alias("single"))


def _start(x: Column) -> Column:
    return F.shiftright(x, 28).bitwiseAND(63).cast("int")


def _size(x: Column) -> Column:
    return F.shiftright(x, 22).bitwiseAND(63).cast("int")


def _merged(edges: Column, single: Column, size: Column) -> Column:
    """The edges on the path of a BPE file, in text order.

    Bit p of the state is a boundary before character p. Seen from an edge's start, both
    its ends are boundaries and one lies between if the bits of its span differ from those
    of its ends in one. (They do, too, if one end is missing and nothing lies between; then
    there is nothing to take away.)
    """
    one, two, left, right = F.expr("1L"), F.expr("2L"), lambda a, k: F.call_function("shiftleft", a, k), lambda a, k: F.call_function("shiftright", a, k)
    span = lambda m, x: right(m, _start(x)).bitwiseAND(left(two, _size(x)) - 1)
    ends = lambda x: left(one, _size(x)) + 1

    def step(m: Column, x: Column) -> Column:
        inside = left(left(one, _size(x)) - 2, _start(x))
        return F.when(F.bit_count(span(m, x).bitwiseXOR(ends(x))) == 1, m.bitwiseAND(F.bitwise_not(inside))).otherwise(m)

    bounds = F.aggregate(F.sort_array(edges), left(one, size + 1) - 1, step)
    kept = lambda m: F.filter(F.concat(edges, single), lambda x: span(m, x) == ends(x))
    path = F.transform(F.array(bounds), kept)[0]
    return F.sort_array(F.transform(path, lambda x: x.bitwiseAND((1 << 34) - 1)))


def _best(edges: Column, size: Column) -> Column:
    """The edges on the path of the best total score, in text order (Viterbi)."""
    none = F.struct(F.lit(float("-inf")).alias("score"), F.lit(-1).cast("long").alias("by"))
    origin = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).cast("long").alias("by")))
    nodes = F.concat(origin, F.array_repeat(none, size))
    order = F.array_sort(F.transform(edges, lambda x: F.struct((_start(x["at"]) + _size(x["at"])).alias("e"), _start(x["at"]).alias("s"), x["at"].alias("at"), x["score"].alias("score"))))

    def step(nodes: Column, x: Column) -> Column:
        score = nodes[x["s"]]["score"] + x["score"]
        return F.when(score > nodes[x["e"]]["score"], F.transform(nodes, lambda v, i: F.when(i == x["e"], F.struct(score.alias("score"), x["at"].alias("by"))).otherwise(v))).otherwise(nodes)

    done = F.aggregate(order, nodes, step)
    back = F.aggregate(
        F.sequence(F.lit(1), size), F.struct(size.alias("at"), F.array().cast("array<bigint>").alias("path"), done.alias("nodes")),
        lambda a, _: F.when(a["at"] <= 0, a).otherwise(F.struct(
            _start(a["nodes"][a["at"]]["by"]).alias("at"), F.concat(F.array(a["nodes"][a["at"]]["by"]), a["path"]).alias("path"), a["nodes"].alias("nodes"))))
    return F.transform(back["path"], lambda x: x.bitwiseAND((1 << 34) - 1))


def _utf8(code: Column, first_byte: int) -> Column:
    """Ids of the bytes of a character."""
    b = lambda shift, lead: F.shiftright(code, shift).bitwiseAND(63) + lead
    out = F.when(code < 0x80, F.array(code)).when(code < 0x800, F.array(F.shiftright(code, 6) + 0xC0, b(0, 0x80)))
    out = out.when(code < 0x10000, F.array(F.shiftright(code, 12) + 0xE0, b(6, 0x80), b(0, 0x80)))
    out = out.otherwise(F.array(F.shiftright(code, 18) + 0xF0, b(12, 0x80), b(6, 0x80), b(0, 0x80)))
    return F.transform(out, lambda x: x + first_byte)


def _long_unit(unit: str, table: dict[str, tuple[int, int, float]], vocabulary: Vocabulary) -> list[int]:
    """The same folds for a unit of any length."""
    n, ids = len(unit), lambda a, z: [table[unit[a:z]][1]] if unit[a:z] in table else [vocabulary.first_byte + b for b in unit[a:z].encode()]
    found = [(table[unit[a:z]], a, z) for a in range(n) for z in range(a + 1, min(n, a + vocabulary.widest) + 1) if unit[a:z] in table]
    if vocabulary.unigram:
        ending: list[list] = [[] for _ in range(n + 1)]
        for (_, _, score), a, z in found:
            ending[z].append((a, score))
        best, back = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for z in range(1, n + 1):
            for a, score in ending[z] if any(a == z - 1 for a, _ in ending[z]) else [(z - 1, -1e6), *ending[z]]:
                if best[a] + score > best[z]:
                    best[z], back[z] = best[a] + score, a
        cuts = [n]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
    else:
        after, live = list(range(1, n + 2)), [True] * (n + 1)
        for _, a, z in sorted((r, a, z) for (r, _, _), a, z in found):
            if live[a] and live[z] and a < z and after[a] < z and after[after[a]] == z:
                live[after[a]], after[a] = False, z
        cuts = [k for k in range(n + 1) if live[k]]
    return [i for a, z in zip(cuts, cuts[1:], strict=False) for i in ids(a, z)]


def count_units(texts: DataFrame, safe: str) -> DataFrame:
    """unit, n (how often it occurs in the prepared texts)."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in slices(batches):
            data, offsets = buffers(b.column("text"))
            starts, _ = cut_units(data, offsets, safe)
            low, high, size = words(data, starts)
            short = size <= SHORT
            held.append(_distinct(low[short], high[short], size[short], np.ones(int(short.sum()), np.int64)))
            if not short.all():
                texts = _texts(data, starts, np.flatnonzero(~short))
                yield pa.RecordBatch.from_arrays([texts, pa.array(np.ones(len(texts), np.int64))], names=["unit", "n"])
            if sum(len(h[0]) for h in held) > GATHERED:
                held = [_distinct(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > GATHERED // 2:
                    yield from _unit_batches(*held.pop())
        if held:
            yield from _unit_batches(*_distinct(*map(np.concatenate, zip(*held, strict=True))))

    return texts.select("text").mapInArrow(one, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"), F.max(F.length("unit")).alias("size"))


def encode_units(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """unit, n (how often it occurs), ids of every unit of prepared texts."""
    spark = texts.sparkSession
    counted = count_units(texts, vocabulary.safe)
    lattice = _edges(counted.where(F.col("size") <= LONGEST), vocabulary.frame(spark), vocabulary.unigram, min(LONGEST, vocabulary.widest))
    size = F.length("unit")
    path = _best(F.col("edges"), size) if vocabulary.unigram else _merged(F.col("edges"), F.col("single"), size)
    lattice = lattice.select("unit", "n", F.transform(path, lambda x: x.bitwiseAND((1 << 22) - 1)).alias("path"))
    spelt = F.flatten(F.transform("path", lambda x: F.when(x < UNKNOWN, F.array(x)).otherwise(_utf8(x - UNKNOWN, vocabulary.first_byte))))
    ids = F.when(F.array_max("path") < UNKNOWN, F.col("path")).otherwise(spelt)
    kind = "smallint" if len(vocabulary.shown) <= 1 << 15 else "int"  # half the bytes to move
    short = lattice.select("unit", "n", ids.cast(f"array<{kind}>").alias("ids"))
    table = {p: (r, i, s) for r, (p, i, s) in enumerate(sorted(vocabulary.pieces, key=lambda p: (-p[2], p[1])))}
    shared = spark.sparkContext.broadcast((table, vocabulary))

    def long_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("unit"), b.column("n"), pa.array([_long_unit(u.as_py(), *shared.value) for u in b.column("unit")], pa.list_(pa.int16() if kind == "smallint" else pa.int32()))], names=["unit", "n", "ids"])

    return short.unionByName(counted.where(F.col("size") > LONGEST).select("unit", "n").mapInArrow(long_ones, short.schema))


def cut_units(data: np.ndarray, offsets: np.ndarray, safe: str = "") -> tuple[np.ndarray, np.ndarray]:
    """The first byte of every unit of prepared texts, and for each text its first unit (and the end)."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    control, space = data < 32, data == 32
    before = lambda x: np.append(False, x[:-1])[:n]
    first = control | edge[:n] | before(control) | (space & ~before(space))
    if safe:
        kinds = np.zeros(256, np.uint8)
        kinds[[b for b in range(128) if chr(b).isalnum()]] = 1
        kinds[0xC3:0xCA] = 2
        kinds[0x80:0xC0] = 3
        kinds[list(safe.encode())] = 4
        k = kinds[data]
        ended = (k == 1) | ((k == 3) & before(k == 2))  # a letter ends here
        first |= ((k == 4) & before(ended)) | (((k == 1) | (k == 2)) & before(k == 4))
    starts = np.flatnonzero(first)
    return starts, np.searchsorted(starts, offsets)


#: What is left of a word of 8 bytes of which the first 0 to 8 count.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first 8 bytes of every unit, the next 8 and its size: all that a unit of at most
    SHORT bytes is."""
    size = np.diff(np.append(starts, len(data)))
    padded = np.concatenate([data, np.zeros(SHORT, np.uint8)])
    every = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))
    return every[starts] & _FIRST[np.minimum(size, 8)], every[starts + 8] & _FIRST[np.clip(size - 8, 0, 8)], size


def _hash(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(low * _BASE + (high ^ (size.astype(np.uint64) << np.uint64(56))) * np.uint64(0xC2B2AE3D27D4EB4F))


def _distinct(low: np.ndarray, high: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Units once each (nearly: those of one hash may repeat), and their counts added up."""
    h = _hash(low, high, size)
    order = np.argsort(h)
    low, high, size, h = low[order], high[order], size[order], h[order]
    at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (size[1:] != size[:-1]))[: len(h)])
    return low[at], high[at], size[at], np.add.reduceat(n[order], at) if len(at) else n


def _unit_batches(low: np.ndarray, high: np.ndarray, size: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(low), 1 << 16):
        part = slice(a, a + (1 << 16))
        flat = np.stack([low[part], high[part]], axis=1).view(np.uint8)[np.arange(SHORT) < size[part, None]]
        at = np.append(0, np.cumsum(size[part])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(flat)), pa.array(n[part])], names=["unit", "n"])


def _texts(data: np.ndarray, starts: np.ndarray, which: np.ndarray) -> pa.Array:
    ends = np.append(starts, len(data))
    return pa.array([data[a:z].tobytes().decode() for a, z in zip(ends[which].tolist(), ends[which + 1].tolist(), strict=True)], pa.string())


@dataclass
class HotUnits:
    """Units of at most SHORT bytes by rank, the most frequent first: their words, and the
    ids of each rank in one flat array."""

    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    slots: np.ndarray | None = None  # ranks and 1 by hash, at the first free place from there

    def _place(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (_hash(low, high, size) >> np.uint64(64 - (8 * len(self.low)).bit_length())).astype(np.int64)

    def _fill(self) -> np.ndarray:
        slots = np.zeros(1 << (8 * len(self.low)).bit_length(), np.uint32)
        left = np.arange(len(self.low))
        place = self._place(self.low, self.high, self.size.astype(np.int64))
        while len(left):
            free = np.flatnonzero(slots[place] == 0)
            slots[place[free]] = left[free] + 1
            taken = slots[place] == left + 1
            left, place = left[~taken], (place[~taken] + 1) % len(slots)
        return slots

    def find(self, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """1 and the rank of each unit, 0 where it isn't held."""
        found = np.zeros(len(low), np.uint32)
        if not len(self.low):
            return found
        if self.slots is None:
            self.slots = self._fill()
        left, place = np.arange(len(low)), self._place(low, high, size)
        while len(left):
            k = self.slots[place]
            at = k.astype(np.int64) - 1  # -1: nothing there
            same = (k > 0) & (self.low[at] == low[left]) & (self.high[at] == high[left]) & (self.size[at] == size[left])
            found[left[same]] = k[same]
            on = np.flatnonzero((k > 0) & ~same)
            left, place = left[on], (place[on] + 1) % len(self.slots)
        return found


def hot_units(units: DataFrame, most: int) -> tuple[HotUnits, DataFrame]:
    """The most frequent units of at most SHORT bytes, `most` at most (a bounded collect), and the others."""
    level = F.floor(F.log2("n") * 16).cast("int")
    short = units.where(F.octet_length("unit") <= SHORT).withColumn("level", level)
    counts = short.groupBy("level").agg(F.count(F.lit(1)).alias("units")).orderBy(F.desc("level")).collect()  # 16 rows for each doubling
    total, least = 0, None
    for r in counts:
        total += r["units"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        none = np.zeros(0, np.uint64)
        return HotUnits(none, none, np.zeros(0, np.uint8), np.zeros(1, np.int32), np.zeros(0, np.int32)), units
    found = short.where(F.col("level") >= least).select("unit", "n", "ids").toArrow().combine_chunks()
    found = found.take(pa.compute.sort_indices(found, [("n", "descending"), ("unit", "ascending")]))
    texts, lists = (found.column(c).combine_chunks() for c in ("unit", "ids"))
    data, offsets = buffers(texts)
    low, high, size = words(data, offsets[:-1])
    flat = lists.flatten().to_numpy()
    at = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy()))).astype(np.int32)
    held = HotUnits(low, high, size.astype(np.uint8), at, flat.astype(np.uint16 if flat.max(initial=0) < 1 << 16 else np.int32))
    return held, units.where((level < least) | (F.octet_length("unit") > SHORT))


def _packed(ranks: np.ndarray) -> bytes:
    """Ranks as three planes of bytes, compressed: frequent units need the first only."""
    return pa.compress(ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 3 * n, "zstd"), np.uint8).reshape(3, n).astype(np.int64)
    return planes[0] | planes[1] << 8 | planes[2] << 16


def encode(docs: DataFrame, vocabulary: Vocabulary, most: int = HOT) -> DataFrame:
    """doc_id, ids, same (whether decoding gives the prepared text): one row for each row of docs."""
    spark = docs.sparkSession
    kind, safe = docs.schema["doc_id"].dataType, vocabulary.safe
    d = docs.select("doc_id", prepared("text").alias("text"))
    units = stage(encode_units(d, vocabulary), "units", SHORT_BATCHES | {IN_MEMORY_GROUPS: str(GROUPS)})
    held, others = hot_units(units, most)
    hot = spark.sparkContext.broadcast(held)
    # 96 bits stand for a row where its parts meet again; equal rows have equal parts.
    h = F.xxhash64("text")
    d = d.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.shiftright(h, 32).cast("int").alias("half"), h.alias("h"), "text")
    key = [T.StructField("key", T.LongType()), T.StructField("half", T.IntegerType())]
    left_over = T.StructType([*key, T.StructField("pos", T.IntegerType()), T.StructField("unit", T.StringType())])
    packed = T.StructType([*key, T.StructField("doc_id", kind), T.StructField("h", T.LongType()), T.StructField("n_units", T.LongType()), T.StructField("ranks", T.BinaryType())])

    def look_up(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data, offsets = buffers(b.column("text"))
        starts, first = cut_units(data, offsets, safe)
        return data, starts, first, hot.value.find(*words(data, starts))

    def not_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, starts, first, k = look_up(b)
            left = np.flatnonzero(k == 0)
            row = np.searchsorted(first, left, side="right") - 1
            keys = b.select(["key", "half"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(left - first[row], pa.int32()), _texts(data, starts, left)], names=left_over.names)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            _, _, first, k = look_up(b)
            ranks = pa.array([_packed(k[a:z]) for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "half", "doc_id", "h")), pa.array(np.diff(first), pa.int64()), ranks], names=packed.names)

    filled = d.select("key", "half", "text").mapInArrow(not_held, left_over).join(others.select("unit", "ids"), "unit").select("key", "half", "pos", "ids")
    filled = filled.repartition("key", "half").groupBy("key", "half").agg(F.collect_set(F.struct("pos", "ids")).alias("rare"))
    filled = stage(filled, "filled", SHORT_BATCHES)  # its shuffles go before the texts move
    whole = d.mapInArrow(numbered, packed).join(filled, ["key", "half"], "left")
    shown = spark.sparkContext.broadcast(vocabulary.shown)
    out = T.StructType([T.StructField("doc_id", kind), T.StructField("h", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, told = hot.value, np.array(shown.value, object)
        for b in slices(batches, "ranks", 1 << 18):
            rows, texts = [], []
            for i in range(b.num_rows):
                k = _unpacked(b.column("ranks")[i].as_buffer(), b.column("n_units")[i].as_py())
                known = k[k > 0] - 1
                counts = table.at[known + 1] - table.at[known]
                ends = np.cumsum(counts)
                ids = table.ids[np.repeat(table.at[known] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int32)
                more = b.column("rare")[i].as_py()
                if more:
                    sizes = np.zeros(len(k), np.int64)
                    sizes[k > 0] = counts
                    before, parts, last = np.append(0, np.cumsum(sizes)), [], 0
                    for x in sorted(more, key=lambda x: x["pos"]):
                        parts += [ids[last : before[x["pos"]]], np.array(x["ids"], np.int32)]
                        last = before[x["pos"]]
                    ids = np.concatenate([*parts, ids[last:]])
                rows.append(ids)
                texts.append(b"".join(told[ids].tolist()).decode(errors="replace"))
            at = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), lists, pa.array(texts, pa.string())], names=out.names)

    done = whole.select("doc_id", "h", "n_units", "ranks", "rare").mapInArrow(merge, out)
    return done.select("doc_id", "ids", (F.xxhash64("text") == F.col("h")).alias("same"))


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, text: what the ids stand for, without the space put before a text."""
    spark = encoded.sparkSession
    shown = spark.sparkContext.broadcast(vocabulary.shown)
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b"".join([shown.value[i] for i in x.as_py() or []]).decode(errors="replace") for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t[1:] if t[:1] == " " else t for t in texts], pa.string())], names=schema.names)

    return encoded.select("doc_id", "ids").mapInArrow(one, schema)
