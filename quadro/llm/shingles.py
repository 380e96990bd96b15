"""Word and shingle hashes of a batch of texts, in numpy over the texts' bytes.

A word is a run of bytes other than ASCII white space, A-Z lower-cased. Its hash is a
64-bit polynomial of its bytes, mixed; a shingle's hash combines those of its words in
order. A shingle stands for its words up to a 64-bit hash collision.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(7))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit over the whole word (in place)."""
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and len(texts) + 1 offsets into them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, some at a time: at most `most` bytes of texts, or
    one row. Memory then follows the longest text, not the batch."""
    for b in batches:
        _, at = buffers(b.column(column))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(at, at[a] + most, side="right")) - 1)
            yield b.slice(a, z - a)
            a = z


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the index of its first word (and the end)."""
    h, at, _ = located_words(data, offsets)
    return h, at


def located_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, and the index of the word that each byte other than white space is in."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~_IS_SPACE[data]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    used = np.flatnonzero(inside)
    first = np.searchsorted(used, starts)
    lengths = np.diff(np.append(first, len(used)))
    word = np.repeat(np.arange(len(starts)), lengths)
    at = np.arange(len(used)) - first[word]
    powers = np.cumprod(np.full(int(lengths.max()), _BASE))
    h = np.add.reduceat(_BYTE[data[used]] * powers[at], first)
    return mix(h + lengths.astype(np.uint64)), np.searchsorted(starts, offsets), word


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `width` words; of a
    shorter text its whole word sequence; of one without words nothing."""
    words, at = word_hashes(*buffers(texts))
    out = []
    joined = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width if len(joined) else 0):
        joined += words[k : k + len(joined)] * _STEP[k]
    joined = mix(joined + np.uint64(width))
    for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if z - a >= width:
            s = np.sort(joined[a : z - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif z > a:
            out.append(mix(np.array([(words[a:z] * _STEP[: z - a]).sum() + np.uint64(z - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()
