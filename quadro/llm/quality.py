"""Quality classifier: a byte-level convolutional network in numpy.

The input is the text's bytes; those of a word that repeats the word before it count as
256 symbols of their own. Windows of WIDTH bytes, every STRIDE bytes over the whole text,
go through learned embeddings, learned filters and a rectifier. Chunks of 2 * HALF windows, overlapping by
half, average the filters' responses; a linear layer of HIDDEN units follows, is
max-pooled over all chunks of the text, and combined into one probability.

It is fitted by Adam on the driver, on a bounded sample of labelled rows (TRAIN_ROWS of
at most TRAIN_BYTES each, by a hash of doc_id), and scores rows within tasks without a
shuffle. The held-out fifth (crc32 of doc_id as text, mod 5) is never used to fit. Only
the text's bytes are inputs.

Defined cases: a null text is empty; an empty text gets the score of a text that
responds to no filter; texts of any length are scored whole; equal texts get equal
scores; labels that are null are ignored, of repeated ones each counts; without any
labels of both kinds every score is 0.5; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadro.llm.common import text_of
from quadro.llm.shingles import _IS_SPACE, buffers, located_words, slices

SYMBOLS, EMBED, FILTERS, HIDDEN, WIDTH, STRIDE, HALF = 512, 4, 16, 8, 8, 4, 32
TRAIN_ROWS, TRAIN_BYTES, EPOCHS, BATCH, RATE, STEPS, SEED = 3000, 1 << 17, 10, 32, 0.01, 600, 5
KEEP_FROM = 0.3
#: Bytes scored at a time.
BLOCK = 1 << 19


@dataclass
class Net:
    embed: np.ndarray  # SYMBOLS x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    shift: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    out: np.ndarray  # HIDDEN
    bias: np.ndarray  # 1

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.shift, self.hidden, self.out, self.bias]


def symbols(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes, plus 256 in a word that repeats the word before it in its text."""
    h, at, word = located_words(data, offsets)
    again = np.append(False, h[1:] == h[:-1])[: len(h)]
    again[at[at < len(h)]] = False
    out = data.astype(np.uint16)
    if again.any():
        inside = np.flatnonzero(~_IS_SPACE[data])
        out[inside[again[word]]] += 256
    return out


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts laid out on whole halves: the padded bytes, the windows that each half holds
    of its text, and the first half of each text (and the end)."""
    size, span = np.diff(offsets), HALF * STRIDE
    halves = (size + WIDTH - STRIDE) // span + 1
    first = np.concatenate([[0], np.cumsum(halves)])
    flat = np.zeros(int(first[-1]) * span + WIDTH, np.uint16)
    at = np.arange(len(data)) + np.repeat(first[:-1] * span - offsets[:-1], size)
    flat[at] = symbols(data, offsets)
    index = np.arange(first[-1]) - np.repeat(first[:-1], halves)
    windows = np.clip(-(-np.repeat(size, halves) // STRIDE) - index * HALF, 0, HALF)
    return flat, windows, first


def responses(net: Net, flat: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows' embeddings, rectified responses masked to real windows, their sum by half)."""
    e = net.embed[flat].reshape(-1)
    n = len(windows) * HALF
    x = np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (STRIDE * EMBED * e.itemsize, e.itemsize))
    x = np.ascontiguousarray(x)
    r = np.maximum(x @ net.filters + net.shift, 0).reshape(-1, HALF, FILTERS)
    if (windows < HALF).any():
        r *= (np.arange(HALF) < windows[:, None])[:, :, None]
    return x, r, r.sum(axis=1)


def chunks(sums: np.ndarray, windows: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean response of the chunk that starts in each half. A text's last half is a chunk
    with the half before it already, unless it is the only one."""
    nxt = np.append(sums[1:], sums[:1] * 0, axis=0)
    more = np.append(windows[1:], 0)
    last = first[1:] - 1
    nxt[last], more[last] = 0, 0
    total = windows + more
    alone = np.zeros(len(windows), bool)
    alone[last[np.diff(first) > 1]] = True
    return (sums + nxt) / np.maximum(total, 1)[:, None], alone


def scores(net: Net, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    flat, windows, first = layout(data, offsets)
    step = max(1, BLOCK // (HALF * STRIDE))
    sums = np.concatenate([
        responses(net, flat[a * HALF * STRIDE : min(a + step, len(windows)) * HALF * STRIDE + WIDTH], windows[a : a + step])[2]
        for a in range(0, len(windows), step)]) if len(windows) else np.zeros((0, FILTERS), np.float32)
    mean, extra = chunks(sums, windows, first)
    z = mean @ net.hidden
    z[extra] = -np.inf
    top = np.maximum.reduceat(z, first[:-1]) if len(z) else z
    return 1 / (1 + np.exp(-(top.astype(np.float64) @ net.out + net.bias[0])))


def fit(texts: list[bytes], labels: list[int]) -> Net:
    """Fits a network; every step looks at BATCH whole texts."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    normal = lambda *s: rng.normal(0, 1, s).astype(np.float32)
    net = Net(normal(SYMBOLS, EMBED) * 0.5, normal(WIDTH * EMBED, FILTERS) * 0.25, np.zeros(FILTERS, np.float32), normal(FILTERS, HIDDEN), normal(HIDDEN) * 0.5, np.zeros(1, np.float32))
    if len(set(labels)) < 2:
        net.out[:] = 0
        return net
    y = np.array(labels, np.float32)
    first, second, t = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    steps = max(STEPS, EPOCHS * -(-len(texts) // BATCH))
    while t < steps:
        order = rng.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            grads = _gradients(net, [texts[i] for i in pick], y[pick])
            t += 1
            rate = RATE * (1 - t / (steps + 1)) + 1e-4
            for p, g, m, v in zip(net.parts(), grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= (rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def _gradients(net: Net, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
    offsets = np.cumsum([0, *map(len, texts)])
    flat, windows, first = layout(np.frombuffer(b"".join(texts), np.uint8), offsets)
    x, r, sums = responses(net, flat, windows)
    mean, extra = chunks(sums, windows, first)
    z = mean @ net.hidden
    z[extra] = -np.inf
    best = np.array([a + z[a:b].argmax(axis=0) for a, b in zip(first[:-1], first[1:], strict=True)])  # text x HIDDEN
    top = np.take_along_axis(z, best, axis=0)
    p = 1 / (1 + np.exp(-(top @ net.out + net.bias[0])))
    d = (p - y) / len(y)
    dz = d[:, None] * net.out
    rows = best.reshape(-1)
    dmean = dz.reshape(-1)[:, None] * net.hidden.T[np.tile(np.arange(HIDDEN), len(y))]
    dhidden = np.zeros_like(net.hidden)
    for k in range(HIDDEN):
        dhidden[:, k] = dz[:, k] @ mean[best[:, k]]
    dsums = np.zeros_like(sums)
    more = np.append(windows[1:], 0)
    more[first[1:] - 1] = 0
    scaled = dmean / np.maximum(windows + more, 1)[rows][:, None]
    np.add.at(dsums, rows, scaled)
    both = more[rows] > 0
    np.add.at(dsums, rows[both] + 1, scaled[both])
    used = np.flatnonzero(np.abs(dsums).sum(axis=1))
    dr = (dsums[used][:, None, :] * (r[used] > 0)).reshape(-1, FILTERS)
    at = (used[:, None] * HALF + np.arange(HALF)).reshape(-1)
    dfilters = x[at].T @ dr
    dx = (dr @ net.filters.T).reshape(-1, EMBED)
    codes = flat[(at[:, None] * STRIDE + np.arange(WIDTH)).reshape(-1)]
    dembed = np.stack([np.bincount(codes, dx[:, k], SYMBOLS) for k in range(EMBED)], axis=1)
    return [dembed.astype(np.float32), dfilters, dr.sum(axis=0), dhidden, d @ top, np.array([d.sum()], np.float32)]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Net:
    """Fits on a bounded sample of the rows that have a label and aren't held out."""
    chosen = labels.where("quality is not null and doc_id is not null").where(~held_out()).select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id", "quality").limit(TRAIN_ROWS)  # proven small: broadcast
    found = docs.select("doc_id", "text").where(F.octet_length(text_of("text")) <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id").select("doc_id", text_of("text").alias("text"), "quality")
    # Ordered before it is cut: where a doc_id repeats, reruns take the same rows.
    rows = sorted(map(tuple, found.orderBy("doc_id", "quality", "text").limit(4 * TRAIN_ROWS).collect()))
    return fit([t.encode() for _, t, _ in rows], [int(q) for *_, q in rows])


def classify(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=BLOCK):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores(net, *buffers(b.column("text"))))], names=schema.names)

    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(one, schema)
    return scored.withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    net = train(docs, labels)
    schema = T.StructType([*docs.schema.fields])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=BLOCK):
            yield b.filter(pa.array(scores(net, *buffers(b.column("text"))) >= KEEP_FROM))

    return docs.mapInArrow(one, schema)
