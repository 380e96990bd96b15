"""HTML extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is a chain of leaf blocks in page order. Each has features of its ancestors (tags
and the words in their class, id and role) and of its text (length, links, punctuation,
place in the page); neighbours are tied by transition weights. The field is trained on
labelled pages (a fixed number, laid out by html_pages) by gradient ascent on the exact
log-likelihood, once on the driver; pages are decoded by Viterbi within tasks, without a
shuffle.

Defined cases: a null or empty html, or one without text, gives an empty text; broken
markup is read as far as it goes; pages of any length are read whole; equal pages give
equal texts; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadro.llm.html_blocks import Block, blocks_of
from quadro.llm.html_pages import labelled_pages

TRAIN_PAGES, PLAIN_PAGES, EPOCHS, RATE, SHRINK = 500, 400, 12, 0.3, 1e-4


def path_features(path: tuple[str, ...]) -> set[str]:
    found = {f"in:{tag}" for tag in (p.split(".")[0] for p in path) if tag not in ("html", "body")}
    for p in path:
        for name in p.split(".")[1:]:
            found |= {f"name:{name}", f"like:{name[:4]}"}
    if path:
        found.add("leaf:" + path[-1].split(".")[0])
    return found


def text_features(block: Block, k: int, n: int) -> set[str]:
    size, marks = len(block.text), sum(map(block.text.count, ".,;:!?"))
    found = {"bias", f"size:{min(9, int(math.log2(size + 1)))}", f"marks:{min(4, marks)}", f"links:{min(4, round(4 * block.linked / max(1, size)))}"}
    if k == 0:
        found.add("first")
    if k == n - 1:
        found.add("last")
    if not block.linked:
        found.add(f"sentences:{min(4, block.text.count('. '))}")
    if "©" in block.text:
        found.add("rights")
    return found


@dataclass
class Field:
    """Weights of label 1 over label 0, and scores[a, b] of label b after label a."""

    weights: dict[str, float]
    follow: np.ndarray
    known: dict[tuple[str, ...], float] = field(default_factory=dict)

    def label(self, blocks: list[Block]) -> list[int]:
        """The best labels (Viterbi)."""
        if not blocks:
            return []
        (s00, s01), (s10, s11) = self.follow.tolist()
        w, back, a, b = self.weights, [], 0.0, 0.0
        for k, x in enumerate(blocks):
            own = self.known.get(x.path)
            if own is None:
                own = sum(w.get(f, 0.0) for f in path_features(x.path))
                if len(self.known) < 100_000:
                    self.known[x.path] = own
            own += sum(w.get(f, 0.0) for f in text_features(x, k, len(blocks)))
            if k:
                back.append((b + s10 > a + s00, b + s11 > a + s01))
                a, b = max(a + s00, b + s10), max(a + s01, b + s11) + own
            else:
                b = own
        labels = [int(b > a)]
        for pair in reversed(back):
            labels.append(int(pair[labels[-1]]))
        return labels[::-1]


def train(pages: list[tuple[str, dict[str, int]]]) -> Field:
    """Maximises the pages' log-likelihood, page by page, with adaptive steps."""
    index: dict[str, int] = {}
    chains = []
    for html, labels in pages:
        blocks = [b for b in blocks_of(html) if b.text in labels]
        rows = [[index.setdefault(f, len(index)) for f in sorted(path_features(b.path) | text_features(b, k, len(blocks)))] for k, b in enumerate(blocks)]
        chains.append((rows, np.array([labels[b.text] for b in blocks])))
    w, follow = np.zeros(len(index)), np.zeros((2, 2))
    seen_w, seen_f = np.full(len(index), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(EPOCHS):
        for rows, y in chains:
            if not rows:
                continue
            own = np.array([w[r].sum() for r in rows])
            node, pair = marginals(own, follow)
            g = np.zeros(len(w))
            for r, d in zip(rows, y - node, strict=True):
                g[r] += d
            g -= SHRINK * w
            seen_w += g * g
            w += RATE * g / np.sqrt(seen_w)
            gf = -pair - SHRINK * follow
            np.add.at(gf, (y[:-1], y[1:]), 1)
            seen_f += gf * gf
            follow = follow + RATE * gf / np.sqrt(seen_f)
    return Field({f: float(w[k]) for f, k in index.items()}, follow)


def marginals(own: np.ndarray, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(label 1) of each block, and the expected counts of label pairs (forward-backward)."""
    n = len(own)
    score = np.stack([np.zeros(n), own], axis=1)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = score[0]
    for k in range(1, n):
        ahead[k] = score[k] + np.logaddexp(ahead[k - 1, 0] + follow[0], ahead[k - 1, 1] + follow[1])
    for k in range(n - 2, -1, -1):
        behind[k] = np.logaddexp(follow[:, 0] + score[k + 1, 0] + behind[k + 1, 0], follow[:, 1] + score[k + 1, 1] + behind[k + 1, 1])
    total = np.logaddexp(*ahead[-1])
    pairs = np.exp(ahead[:-1, :, None] + follow + (score + behind)[1:, None, :] - total).sum(axis=0) if n > 1 else np.zeros((2, 2))
    return np.exp(ahead + behind - total)[:, 1], pairs


def main_text(page: Field, html: str | None) -> str:
    blocks = blocks_of(html)
    return "\n\n".join(b.text for b, label in zip(blocks, page.label(blocks), strict=True) if label)


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages."""
    model = model or train(labelled_pages(TRAIN_PAGES, plain=PLAIN_PAGES))
    schema = T.StructType([*(pages.schema[c] for c in ("page_id", "url")), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(model, h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select("page_id", "url", "html").mapInArrow(one, schema)
