"""Whitening of vectors by the leading eigenvectors of their covariance.

The eigenvectors come from Chebyshev-filtered subspace iteration. What is done with the
vectors is one kind of pass: each task multiplies its centred rows with a small matrix and
sums; Spark adds the tasks' sums, cell by cell, so the driver gets dimension x block
numbers whatever the number of rows (those of FEW_TASKS at most come as they are). The polynomial's recurrence damps the
unwanted part of the spectrum; QR and Rayleigh-Ritz follow, until the residuals certify
the wanted pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadro.llm.common import SHORT_BATCHES, held, stage

#: Components that are returned, and columns of the block beside them.
KEEP, SPARE = 16, 16
#: Passes that look for the ends of the spectrum, and the most of one filter.
LOOK, DEGREE = 12, 24
#: A filter grows the wanted part by a factor of e^SPREAD at most, and no part of it by more than that above another.
SPREAD = 23.0
#: Residuals, as a share of the largest eigenvalue: aimed at, and still certified where rounding ends the progress.
AIM, CERTIFIED, ROUNDS = 2e-14, 1e-11, 60
#: An eigenvalue under this share of the largest is 0.
ZERO = 1e-12
LARGEST = float(1 << 53)
#: Bytes of the fit list in a task, about; sums of so few tasks are added on the driver.
TASK_BYTES, FEW_TASKS = 16 << 20, 64

Sums = Callable[[np.ndarray], np.ndarray]


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * c) of each entry (array of long; within 2^53 either way); null where the vector
    is null or empty, or an entry is null or not finite."""
    entry = lambda c: c.cast("double")
    good = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(entry(c)) < float("inf")))
    held_in = lambda c: F.greatest(F.least(F.floor(F.least(F.greatest(entry(c) * scale, F.lit(-LARGEST)), F.lit(LARGEST))), F.lit(1 << 53)), F.lit(-(1 << 53)))
    return F.when(good, F.transform(vector, held_in))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, width: int, tasks: int, f: Sums) -> np.ndarray:
    """The sum over all rows, read by so many tasks, of f(matrix of some rows, `width` columns), which is a flat array of a fixed size."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                own = f(_matrix(b.column(0)))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.from_numpy_dtype(total.dtype)))], ["sums"])

    kind = "bigint" if f(np.zeros((1, width), np.int64)).dtype == np.int64 else "double"
    with held(rows.sparkSession, SHORT_BATCHES):
        parts = rows.mapInArrow(part, f"sums array<{kind}>")
        if tasks <= FEW_TASKS:
            return np.sum([r[0] for r in parts.collect()], axis=0)
        found = parts.select(F.posexplode("sums").alias("cell", "v")).groupBy("cell").agg(F.sum("v").alias("v")).collect()
    return np.array([v for _, v in sorted(found)])


class Fit:
    """Distinct vectors, their number n and exact sums, and passes over them, centred."""

    def __init__(self, fit: DataFrame, width: int) -> None:
        n, files = fit.count(), fit.rdd.getNumPartitions()
        self.tasks = max(1, math.ceil(8 * width * n / TASK_BYTES))
        if files > 2 * self.tasks:  # many small files would be opened again in every pass
            fit = stage(fit.repartition(self.tasks), "fit")
        self.tasks = max(self.tasks, fit.rdd.getNumPartitions())
        self.fit, self.width = fit, width
        halves = _summed(fit, width, self.tasks, lambda x: np.concatenate([np.array([len(x)]), (x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0)]))
        self.n = int(halves[0])
        self.sums = [(int(a) << 26) + int(b) for a, b in zip(halves[1 : width + 1], halves[width + 1 :], strict=True)]
        # x - S/n as (x - pivot) - rest: the first is exact, the second at most 1/2
        self.pivot = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        self.left = [s - self.n * int(p) for s, p in zip(self.sums, self.pivot, strict=True)]
        self.rest = np.array(self.left, float) / self.n

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.pivot).astype(float) - self.rest

    def total(self, f: Sums) -> np.ndarray:
        """The mean over the fit list of f(centred rows)."""
        pivot, rest = self.pivot, self.rest
        return _summed(self.fit, self.width, self.tasks, lambda x: f((x - pivot).astype(float) - rest)) / self.n

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times q."""
        return self.total(lambda c: (c.T @ (c @ q)).ravel()).reshape(q.shape)


def _ends(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, passes: int) -> tuple[float, np.ndarray]:
    """The low end of the spectrum, by Lanczos steps of one vector, and the block after as many steps of power iteration, which ride in the same passes."""
    v = np.ones(len(block)) / math.sqrt(len(block))
    basis, alpha, beta = [v], [], []
    for _ in range(passes):
        both = times(np.column_stack([block, basis[-1]]))
        block, w = both[:, :-1] / max(np.abs(both[:, :-1]).max(), 1e-300), both[:, -1]
        alpha.append(float(basis[-1] @ w))
        for _ in range(2):  # orthogonal to all before, so that rounding adds no copies
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        beta.append(float(np.linalg.norm(w)))
        if beta[-1] <= 1e-12 * max(alpha):
            break
        basis.append(w / beta[-1])
    theta, s = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: len(alpha) - 1], 1) + np.diag(beta[: len(alpha) - 1], -1))
    return max(0.0, float(theta[0] - beta[-1] * abs(s[-1, 0]))), block


def _filtered(times: Callable[[np.ndarray], np.ndarray], away: Callable[[np.ndarray], np.ndarray], x: np.ndarray, ax: np.ndarray, degree: int, low: float, high: float, top: float) -> np.ndarray:
    """The Chebyshev polynomial that is at most 1 (scaled by its value at top) on [low, high], applied to x by its recurrence; ax is the covariance times x.

    away: takes the pairs done out of each step, since to the filter they have eigenvalue 0, which is outside [low, high]."""
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = first = half / (top - middle)
    before, now = x, (ax - middle * x) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, away((times(now) - middle * now) * (2 * after / half) - (sigma * after) * before)
        sigma = after
    return now


def leading(times: Callable[[np.ndarray], np.ndarray], width: int, keep: int = KEEP, spare: int = SPARE) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues (falling, at most `keep`, none of them 0) and their unit eigenvectors, as columns.

    A pair is done when its residual |Vq - eq| is at most AIM of the largest eigenvalue, or, where
    rounding stops it from falling further, CERTIFIED of it. The pairs done leave the block,
    largest first, and the passes after them work at right angles to them: so an eigenvalue far
    above the others doesn't drown these in the filter, whose degree is bounded for the same
    reason. A last Rayleigh-Ritz over all pairs certifies them together; ArithmeticError
    if they aren't done in ROUNDS or not certified.
    """
    size = min(width, keep + spare)
    if size == width:
        x, low = np.eye(width), 0.0
    else:
        x = np.random.Generator(np.random.PCG64(5)).standard_normal((width, size))
        low, x = _ends(times, x, LOOK)
    done, values, last = np.zeros((width, 0)), [], math.inf
    away = lambda y: y - done @ (done.T @ y)
    for _ in range(ROUNDS):
        x = np.linalg.qr(away(np.linalg.qr(away(x))[0]))[0]
        ax = away(times(x))
        h = x.T @ ax
        e, u = np.linalg.eigh((h + h.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        x, ax = x @ u, ax @ u
        top = values[0] if values else float(e[0])
        wanted = int((e[: keep - len(values)] > ZERO * top).sum()) if top > 0 else 0
        worst = np.linalg.norm(ax[:, :wanted] - x[:, :wanted] * e[:wanted], axis=0) / top if wanted else np.zeros(0)
        good = worst <= AIM
        if wanted and worst[0] <= CERTIFIED and worst[0] > last / 2:
            good = worst <= max(AIM, 2 * float(worst[0]))
        n = int(np.cumprod(good).sum())
        last = float(worst[n]) if n < wanted else math.inf
        done, values = np.column_stack([done, x[:, :n]]), values + e[:n].tolist()
        x, ax, e, wanted = x[:, n:], ax[:, n:], e[n:], wanted - n
        if not wanted:
            break
        high = max(float(e[-1]), ZERO * top)
        low = min(low, 0.9 * high)
        grown = lambda v, high=high, low=low: math.acosh((max(v, high * (1 + 1e-9)) - (high + low) / 2) / ((high - low) / 2))  # noqa: E731  (a filter's growth at v, as a logarithm for each degree)
        if grown(float(e[wanted - 1])) * DEGREE < 2:  # more equal eigenvalues than the block has columns: damp what is well below them
            high = (low + high) / 2
            low = min(low, 0.9 * high)
        least, most = grown(float(e[wanted - 1]), high, low), grown(float(e[0]), high, low)
        degree = max(2, min(DEGREE, math.ceil(SPREAD / least), int(SPREAD / max(most - least, 1e-9))))
        x = _filtered(times, away, x, ax, degree, low, high, max(float(e[0]), high * (1 + 1e-6)))
    else:
        raise ArithmeticError(f"the eigenvectors' residuals stay at {last:.1e} of the largest eigenvalue")
    if not values:
        return np.zeros(0), done
    q = np.linalg.qr(done)[0]
    aq = times(q)
    h = q.T @ aq
    e, u = np.linalg.eigh((h + h.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    q, aq = q @ u, aq @ u
    if (worst := float(np.linalg.norm(aq - q * e, axis=0).max() / e[0])) > 10 * CERTIFIED:
        raise ArithmeticError(f"the eigenvectors' residuals are {worst:.1e} of the largest eigenvalue")
    return e, q * np.sign(q[np.abs(q).argmax(0), np.arange(len(e))])


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 64, keep: int = KEEP) -> DataFrame:
    """Each row's whitened components: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or empty, or holds an entry that is null or not finite, are left
    out; so are vectors of another length than the commonest (of equally common ones the
    longest). Rows that repeat a key or vector all return; the fit counts each quantised
    vector once. Components whose eigenvalue is 0 (constant or dependent dimensions, a single
    vector) don't exist, so there may be fewer than `keep`, or no row at all. deviation is null
    where it passes a long. Other columns are ignored; key may be null.
    """
    x = rows.select(F.col(key).alias("_key"), quantised(F.col(vector), scale).alias("_x")).where("_x is not null")
    sizes = x.groupBy(F.size("_x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    kind = rows.schema[key].dataType
    schema = f"`{key}` {kind.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if sizes is None:
        return rows.sparkSession.createDataFrame([], schema)
    width = sizes["size"]
    x = x.where(F.size("_x") == width)
    fit = Fit(stage(x.select("_x").distinct(), "fit"), width)
    e, q = leading(fit.times, width, keep)
    if not len(e):
        return rows.sparkSession.createDataFrame([], schema)
    to = q / np.sqrt(e)
    trace = float(fit.total(lambda c: np.array([(c * c).sum()]))[0])
    near = fit.total(lambda c: ((z := c @ to).T @ z).ravel()).reshape(len(e), len(e))
    error, explained = float(np.abs(near - np.eye(len(e))).max()), e / trace
    n, pivot, rest, left = fit.n, fit.pivot, fit.rest, fit.left

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(to[0])
        names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for b in batches:
            if not b.num_rows:
                continue
            d = _matrix(b.column("_x")) - pivot
            z = (d.astype(float) - rest) @ to
            far = float(np.abs(d).max()) * n + max(abs(v) for v in left)
            if far * far * len(pivot) < 2.0**62:
                deviation = pa.array(((d * n - np.array(left, np.int64)) ** 2).sum(1))
            else:
                whole = [sum((n * int(v) - s) ** 2 for v, s in zip(r, left, strict=True)) for r in d.tolist()]
                deviation = pa.array([v if v < 1 << 63 else None for v in whole], pa.int64())
            each, m = np.repeat(np.arange(b.num_rows), k), b.num_rows * k
            yield pa.RecordBatch.from_arrays([
                b.column("_key").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(np.full(m, n)), deviation.take(pa.array(each)),
                pa.array(z.ravel()), pa.array(np.tile(explained, b.num_rows)), pa.array(np.full(m, error))], names)

    return x.mapInArrow(apply, schema)
