"""Many fits in one pass over the rows.

``sum_over_rows`` turns every Arrow batch into one vector of sums and adds the
vectors up: per partition, then by a fixed number of Spark tasks, then on the
driver. A pass may serve any number of candidates at once (settings, folds,
trial steps), so a grid search costs as many jobs as its slowest candidate needs
steps, not as many as all of them together.

``Blocks`` are rows packed once, column after column, into compressed byte blocks of a few
hundred rows that Spark keeps on disk: a pass over them moves bytes to Python instead of
turning rows into Arrow columns again, numpy works on pieces that fit a cache, and neither
the heap nor Arrow's buffers ever hold the rows of a partition at their full size.
Blocks ``by`` a column hold rows of one value of it only, so that a pass leaves a
fold out by leaving out blocks instead of masking rows.

``Descent`` is the driver's side of one candidate: L-BFGS with backtracking, cut
at every evaluation, so that candidates advance independently of each other.
``descend_ahead`` evaluates the next points of a line in the same pass as the
first: a refused step then costs no further pass, and the path stays the same.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.models.gram import MERGE_TASKS

#: steps in a row with less than the relative gain ``tol`` that end a descent
SMALL_STEPS = 3
#: rows of a block, and of a partition of blocks at most
BLOCK_ROWS, PARTITION_ROWS = 512, 1_000_000
#: columns of few values (dummies, labels, folds) shrink to a fraction
CODEC = "zstd"
#: points of a line tried in one pass at most
MAX_AHEAD = 8


@dataclass(frozen=True)
class Blocks:
    """Rows of doubles without NULL as byte blocks, kept by Spark (``packed``: size of a block
    and its compressed bytes)."""
    packed: DataFrame
    columns: tuple[str, ...]
    partitions: int

    @property
    def frame(self) -> DataFrame:
        """The blocks at their full size (column ``block``)."""
        def part(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([raw.to_pybytes() for raw in unpacked(b)], pa.binary())], names=["block"])

        return self.packed.mapInArrow(part, "block binary")

    def counts(self, column: str) -> dict[float, int]:
        """Rows by the value of a column of few values (a fold, a label)."""
        at, k = self.columns.index(column), len(self.columns)

        def part(batches):
            for b in batches:
                for raw in unpacked(b):
                    values, n = np.unique(np.frombuffer(raw).reshape(k, -1)[at], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n, pa.int64())], names=["value", "n"])

        found = self.packed.mapInArrow(part, "value double, n long").groupBy("value").agg(F.sum("n").alias("n")).collect()
        return {float(r["value"]): int(r["n"]) for r in found}

    def unpersist(self) -> None:
        self.packed.unpersist()


def unpacked(batch: pa.RecordBatch) -> Iterator[pa.Buffer]:
    for size, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield pa.decompress(raw.as_buffer(), size, CODEC)


def in_blocks(data: DataFrame, columns: Sequence[str], by: str | None = None) -> Blocks:
    """``columns`` of ``data`` (numbers without NULL) as kept blocks, over all cores and
    at most about ``PARTITION_ROWS`` rows a partition."""
    key = list(columns).index(by) if by else None

    def pack(batches):
        for b in batches:
            if b.num_rows:
                m = np.vstack([c.to_numpy(zero_copy_only=False).astype(float, copy=False) for c in b.columns])
                parts = [m] if key is None else [m[:, m[key] == v] for v in np.unique(m[key])]
                made = [part[:, i:i + BLOCK_ROWS].tobytes() for part in parts for i in range(0, part.shape[1], BLOCK_ROWS)]
                yield pa.RecordBatch.from_arrays([pa.array([len(raw) for raw in made], pa.int32()),
                                                  pa.array([pa.compress(raw, CODEC, asbytes=True) for raw in made], pa.binary())], names=["size", "packed"])

    rows = data.select(*columns)
    want = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PARTITION_ROWS))
    have = rows.rdd.getNumPartitions()
    if have < want:
        rows, have = rows.repartition(want), want
    return Blocks(rows.mapInArrow(pack, "size int, packed binary").persist(StorageLevel.DISK_ONLY), tuple(columns), have)


def sum_over_rows(data: DataFrame | Blocks, columns: Sequence[str], fn: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over all rows of ``fn(block)``, a vector of ``width`` numbers for a
    block of rows x ``columns`` (doubles without NULL)."""
    packed = isinstance(data, Blocks)
    at, k = ([data.columns.index(c) for c in columns], len(data.columns)) if packed else ([], 0)

    def one(total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, width], pa.int32()), pa.array(total))], names=["s"])

    def part(batches):
        total = np.zeros(width)
        for b in batches:
            if packed:
                for raw in unpacked(b):
                    total += fn(np.frombuffer(raw).reshape(k, -1)[at].T)
            elif b.num_rows:
                total += fn(np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float, copy=False))
        yield one(total)

    def add_up(batches):
        total = np.zeros(width)
        for b in batches:
            total += b.column(0).flatten().to_numpy().reshape(-1, width).sum(axis=0)
        yield one(total)

    sums = (data.packed if packed else data.select(*columns)).mapInArrow(part, "s array<double>")
    if (data.partitions if packed else data.rdd.getNumPartitions()) > MERGE_TASKS:
        sums = sums.repartition(MERGE_TASKS).mapInArrow(add_up, "s array<double>")
    rows = sums.collect()
    return np.sum([np.asarray(r["s"], dtype=float) for r in rows], axis=0) if rows else np.zeros(width)


def spread(data: DataFrame) -> DataFrame:
    """``data`` over all cores: an input of a few files would keep most of them
    idle in every pass of an iterative fit."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    return data.repartition(cores) if data.rdd.getNumPartitions() < cores else data


class Descent:
    """L-BFGS from ``theta``: evaluate at ``trial``, hand the value and gradient
    to ``tell``, until ``done``. ``theta``, ``value`` hold the best point so far."""

    def __init__(self, theta: np.ndarray, max_iter: int, tol: float, memory: int = 10):
        self.theta, self.trial, self.value, self.grad = theta, theta, np.inf, np.zeros_like(theta)
        self.max_iter, self.tol, self.iterations, self.done, self.small = max_iter, tol, 0, False, 0
        self.pairs: deque = deque(maxlen=memory)
        self.step, self.direction, self.slope = 1.0, np.zeros_like(theta), 0.0
        self.refused = self.refused_before = 0         # points of the present line, of the last one

    def ahead(self, spare: int = 0) -> list[float]:
        """Step of ``trial`` and the steps that follow it on its line if it is refused, as many
        as the last line refused and ``spare``, or twice as many as this one did so far."""
        steps = [self.step]
        n = min(MAX_AHEAD, 1 + max(self.refused_before + spare, 2 * self.refused)) if np.isfinite(self.value) else 1
        while len(steps) < n and steps[-1] * 0.3 >= 1e-10:
            steps.append(steps[-1] * 0.3)
        return steps

    def tell(self, value: float, grad: np.ndarray) -> None:
        if self.done:
            return
        if np.isfinite(self.value) and not value <= self.value + 1e-4 * self.step * self.slope:
            self.step *= 0.3                       # too far: try nearer
            self.refused += 1
            if self.step < 1e-10:
                if not self.pairs:
                    self.done = True
                    return
                self.pairs.clear()                 # start again along the gradient
                self.refused = 0
                self._aim()
            self.trial = self.theta + self.step * self.direction
            return
        gain = self.value - value
        if np.isfinite(self.value):
            s, y = self.trial - self.theta, grad - self.grad
            if float(s @ y) > 1e-12 * float(y @ y) ** 0.5 * float(s @ s) ** 0.5:
                self.pairs.append((s, y))
            self.iterations += 1
            self.refused_before, self.refused = self.refused, 0
        self.theta, self.grad, self.value = self.trial, grad, value
        # one short step may gain little: stop after several in a row
        self.small = self.small + 1 if gain <= self.tol * max(abs(value), self.tol) else 0
        if self.small >= SMALL_STEPS or self.iterations >= self.max_iter or not np.any(grad):
            self.done = True
            return
        self._aim()
        self.trial = self.theta + self.step * self.direction

    def _aim(self) -> None:
        q, kept = self.grad.copy(), []
        for s, y in reversed(self.pairs):
            a = float(s @ q) / float(s @ y)
            q -= a * y
            kept.append(a)
        if self.pairs:
            s, y = self.pairs[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(self.pairs, reversed(kept)):
            q += s * (a - float(y @ q) / float(s @ y))
        self.direction, self.slope = -q, -float(self.grad @ q)
        if self.slope >= 0:
            self.pairs.clear()
            self.direction, self.slope = -self.grad, -float(self.grad @ self.grad)
        self.step = 1.0 if self.pairs else min(1.0, 1.0 / max(float(np.linalg.norm(self.grad)), 1e-12))


def descend(runs: Sequence[Descent], evaluate: Callable[[list[int]], tuple[np.ndarray, np.ndarray]]) -> int:
    """Step all runs until each is done; one ``evaluate`` (a Spark job) per step
    for those still open. It returns values and gradients (one row per run).
    Returns the number of jobs."""
    jobs = 0
    while open_ := [i for i, r in enumerate(runs) if not r.done]:
        values, grads = evaluate(open_)
        jobs += 1
        for k, i in enumerate(open_):
            runs[i].tell(float(values[k]), grads[k])
    return jobs


def descend_ahead(runs: Sequence[Descent], evaluate: Callable[[list[int], list[list[float]]], Sequence[Sequence[tuple[float, np.ndarray]]]],
                  spare: int = 0) -> int:
    """``descend`` with the steps of ``Descent.ahead`` in one job: ``evaluate`` gets the runs
    and the steps of each along its direction, and returns the value and gradient of each.
    Every run takes the steps that it takes in ``descend``."""
    jobs = 0
    while open_ := [i for i, r in enumerate(runs) if not r.done]:
        steps = [runs[i].ahead(spare) for i in open_]
        found = evaluate(open_, steps)
        jobs += 1
        for i, tried, told in zip(open_, steps, found):
            run, line = runs[i], runs[i].direction
            for step, (value, grad) in zip(tried, told):
                if run.done or run.direction is not line or run.step != step:
                    break                              # the line ended before this point
                run.tell(float(value), grad)
    return jobs
