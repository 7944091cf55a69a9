"""Embedding whitening by Chebyshev-filtered subspace iteration over distributed passes.

Vectors become integers, x = floor(1024 c) + 100000, and are written once as blocks of rows.  The covariance V is never formed:
a pass computes XᵀXQ / n for a thin block Q, each task from its own rows, centred before multiplying.
A round applies a polynomial of V to Q by the Chebyshev recurrence (one pass for each degree), scaled so that the unwanted spectrum, from 0 to the
smallest Ritz value, is damped while what lies above grows; then QR, one more pass, and Rayleigh-Ritz.  It ends when the residual
|V q - e q| of every wanted pair is at most ``TOLERANCE`` of the largest eigenvalue; pairs that meet it are locked.  The degree is chosen in each round so that growth
keeps the weakest wanted direction above rounding.

Shape of the job: one row of partial sums for each task and pass, added up in two levels, so the driver gets the square root of the number of
tasks in matrices of d by ``components + EXTRA``; tasks hold a block at a time; no shuffle of vectors.  The blocks
are in the shared folder, so a lost executor repeats its part of one pass.

Defined results: vectors that are null, or hold null or non-finite entries, go, as do those without entries and those with an entry beyond ±``LARGEST``, which has no such integer;
of vectors of unlike length the most common length (of equals the longest) is kept.  Directions without variance have
no component, so constant vectors, a single vector and an empty table give no rows.  Rows may repeat a vec_id or have none; other columns
are not read.  ``deviation`` is null where it does not fit a long (from some millions of rows on): ``deviation_wide`` then has it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

COMPONENTS, EXTRA = 8, 16
#: Degrees of the filter: a usual round, and one where the wanted values stand so little above the rest that lower degrees hardly grow.
DEGREE, MOST_DEGREE = 10, 160
#: Residual that certifies, as a share of the largest eigenvalue; what rounding may leave; rounds after which the fit is given up.
TOLERANCE, ROUNDING, MOST_ROUNDS = 1e-13, 1e-12, 200
SCALE, SHIFT, LARGEST = 1024, 100_000, 2.0**40
#: Of the trace, below which an eigenvalue counts as none.
NO_VARIANCE = 1e-12
BLOCK_BYTES = 4 << 20
#: Growth of the first direction over the last wanted one that a round may reach.
MOST_GROWTH = 1e8

BLOCKS = "dims int, n int, ids array<long>, x binary"
ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"


def blocks(embeddings: DataFrame) -> DataFrame:
    """The vectors that count, as integers, in blocks of rows; written."""
    small_batches(embeddings.sparkSession)
    c = F.col("embedding").cast("array<double>")
    good = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = (np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False)).astype(np.int64) + SHIFT).astype("<i8")
            ends = np.cumsum(sizes)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                step = max(1, BLOCK_BYTES // (8 * d))
                for k in range(0, len(at), step):
                    rows = at[k : k + step]
                    x = flat[(ends[rows] - d)[:, None] + np.arange(d)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([d], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([b.column(0).take(pa.array(rows)).to_pylist()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())],
                        [f.split()[0] for f in BLOCKS.split(", ")],
                    )

    return written(embeddings.where(good).select(F.col("vec_id").cast("long"), c.alias("x")).mapInArrow(run, BLOCKS), "vectors", "zstd")


def summed(made: DataFrame, dims: int, shape: tuple[int, ...], kind: str, partial: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of ``partial(x)``; tasks add up their own, then groups of tasks, then the driver, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for b in batches:
            for raw in b.column(0):
                total += partial(np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dims))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, least = np.zeros(shape, kind), -1
        for b in batches:
            for task, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total, least = total + np.frombuffer(raw, kind).reshape(shape), task if least < 0 else least
        if least >= 0:
            yield pa.RecordBatch.from_arrays([pa.array([least], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "part"])

    source = made.select("x")
    parts = source.mapInArrow(run, "task long, part binary")
    tasks = source.rdd.getNumPartitions()
    if tasks > 64:
        groups = math.isqrt(tasks)
        parts = parts.repartitionByRange(groups, "task").sortWithinPartitions("task").mapInArrow(add, "task long, part binary")
    total = np.zeros(shape, kind)
    for row in sorted(parts.collect(), key=lambda r: r["task"]):
        total += np.frombuffer(row["part"], kind).reshape(shape)
    return total


class Whitening(NamedTuple):
    """Components by falling eigenvalue, as columns, and what they were fitted on."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return self.sums / max(self.n, 1)


def filtered(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, top: float, edge: float, degree: int) -> np.ndarray:
    """A Chebyshev polynomial of the operator on ``q``: at most 1 in size on [0, edge], scaled to 1 at ``top``."""
    centre = half = edge / 2
    first = sigma = half / (top - centre)
    before, now = q, (apply(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (apply(now) - centre * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


def subspace(apply: Callable[[np.ndarray], np.ndarray], dims: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``wanted`` largest eigenvalues and vectors of the operator, and the largest residual as a share of the first.

    Leading pairs that meet the tolerance are locked: the filter works beside them, so that a dominant direction does not
    limit the degree for the rest.  A residual within ``ROUNDING`` that no round betters counts as met.
    """
    width = min(dims, wanted + EXTRA)
    q = np.eye(dims) if width == dims else np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    last = math.inf
    for _ in range(MOST_ROUNDS):
        vq = apply(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = float(values[0])
        if top <= 0:
            return np.zeros(0), q[:, :0], 0.0
        each = np.linalg.norm(vq - q * values, axis=0)[:wanted] / top
        residual = float(each.max())
        if residual <= TOLERANCE or width == dims or residual <= ROUNDING and residual > last / 2:
            return values[:wanted], q[:, :wanted], residual
        last = residual
        locked = int(np.argmax(each > TOLERANCE))
        held, first = q[:, :locked], float(values[locked])
        edge = max(float(values[-1]), 1e-6 * first)
        rise = lambda v: math.acosh(max(1.0, 2 * v / edge - 1))
        weakest = rise(float(values[wanted - 1]))
        wished = min(max(DEGREE, int(3 / max(weakest, 1e-9))), MOST_DEGREE)
        degree = max(2, min(wished, int(math.log(MOST_GROWTH) / max(rise(first) - weakest, 1e-9))))
        beside = lambda y: y - held @ (held.T @ y)  # noqa: E731, B023
        q[:, locked:] = filtered(lambda y: beside(apply(y)), beside(q[:, locked:]), max(first, edge * 1.0001), edge, degree)
        q = np.linalg.qr(q)[0]
    raise ArithmeticError(f"no certified components after {MOST_ROUNDS} rounds: residual {residual:.1e}")


def fitted(made: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all vectors of ``blocks`` of the most common length; None where there is nothing to fit."""
    lengths = made.groupBy("dims").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return None
    dims, n = lengths
    made = made.where(F.col("dims") == dims)
    sums = summed(made, dims, (dims,), "<i8", lambda x: x.sum(axis=0))
    mean, passes = sums / n, [0]
    trace = float(summed(made, dims, (1,), "<f8", lambda x: np.square(x - mean).sum(keepdims=True).reshape(1)).item()) / n

    def apply(q: np.ndarray) -> np.ndarray:
        passes[0] += 1

        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ q)

        return summed(made, dims, q.shape, "<f8", part) / n

    if trace <= 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0, 0)
    values, vectors, residual = subspace(apply, dims, min(components, dims))
    real = values > NO_VARIANCE * trace
    return Whitening(n, sums, values[real], vectors[:, real], trace, residual, passes[0])


def identity_error(made: DataFrame, fit: Whitening) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, from passes over all of them."""
    dims, k, mean, turn = len(fit.sums), len(fit.values), fit.mean, fit.vectors / np.sqrt(fit.values)
    middle = summed(made, dims, (k,), "<f8", lambda x: ((x - mean) @ turn).sum(axis=0)) / fit.n

    def part(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ turn - middle
        return w.T @ w

    return float(np.abs(summed(made, dims, (k, k), "<f8", part) / fit.n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[list, list]:
    """Exact sums over dimensions of (n x - S)², as longs and, where one does not fit, as decimals."""
    size = (float(np.abs(x).max(initial=0)) + float(np.abs(sums / n).max(initial=0))) * n
    if size < 2.0**62 and size * size * x.shape[1] < 2.0**62:
        return np.square(n * x - sums).sum(axis=1).tolist(), [None] * len(x)
    spread = np.abs(x - sums / n).max(initial=0) * n
    if size < 2.0**62 and spread * spread * x.shape[1] < 2.0**62:
        return np.square(n * x - sums).sum(axis=1).tolist(), [None] * len(x)
    exact = [sum(v * v for v in row) for row in (n * x.astype(object) - sums.astype(object)).tolist()]
    return [v if v < 1 << 63 else None for v in exact], [None if v < 1 << 63 else Decimal(v) for v in exact]


def whitened(made: DataFrame, fit: Whitening, error: float) -> DataFrame:
    """A row for each vector and component."""
    dims, k = len(fit.sums), len(fit.values)
    n, sums, mean, turn, explained = fit.n, fit.sums, fit.mean, fit.vectors / np.sqrt(fit.values), fit.values / fit.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, raw in zip(b.column(0), b.column(1)):
                x = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dims)
                long, wide = deviations(x, n, sums)
                ids, rows = ids.values, len(x)
                each = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, n, np.int64)), pa.array(long, pa.int64()).take(each),
                        pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error)), pa.array(wide, pa.decimal128(38, 0)).take(each),
                    ],
                    [f.split()[0] for f in ROWS.split(", ")],
                )

    return made.where(F.col("dims") == dims).select("ids", "x").mapInArrow(run, ROWS)


def report(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error (and deviation_wide) for each vector and component."""
    made = blocks(embeddings)
    fit = fitted(made, components)
    if fit is None or not len(fit.values):
        return embeddings.sparkSession.createDataFrame([], ROWS)
    return whitened(made, fit, identity_error(made.where(F.col("dims") == len(fit.sums)), fit))
