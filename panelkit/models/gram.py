"""Distributed cross-products.

Narrow unweighted designs (<= 8 columns): one JVM aggregate of means and
pairwise ``covar_pop``.  Wide designs (spline bases, many dummies): one pass in
which each partition turns its Arrow batches into numpy blocks and keeps a weight
total, a mean vector and the cross-product matrix centred on that mean
(updated batch by batch with the parallel-variance formula).  The driver
merges a fixed number of partials, already combined by Spark tasks, and does p x p linear
algebra only.  Row work is one scan; design expressions
(dummies, spline bases) are evaluated once per row in the projection that
feeds the batches.

Centring avoids the cancellation of raw sums; scaling to unit variance
(exact, on the driver) keeps the p x p solve well conditioned (raw columns
of very different scales give condition numbers ~1e12).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Gram:
    names: list[str]          # predictor names (no intercept)
    n: float                  # (weighted) row count
    mean: np.ndarray          # predictor means
    scale: np.ndarray         # predictor sds (1 where constant)
    ymean: float
    zz: np.ndarray            # Z'Z, Z = standardised predictors (centred)
    zy: np.ndarray            # Z'(y - ymean)
    yy: float                 # (y - ymean)'(y - ymean)

    @property
    def p(self) -> int:
        return len(self.names)


JVM_MAX_COLUMNS = 8
#: partials that reach the driver
MERGE_TASKS = 16


def jvm_moments(d: DataFrame, cols: Sequence[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """One JVM aggregate for narrow unweighted designs: count, means and
    ``covar_pop`` for every pair (numerically stable streaming updates merged
    with the parallel formula); no Python workers involved."""
    cols = list(cols)
    k = len(cols)
    row = d.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                *[F.covar_pop(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
                ).collect()[0]
    n = float(row["n"])
    if n == 0:
        return 0.0, np.zeros(k), np.zeros((k, k))
    mean = np.array([float(row[f"m{i}"]) for i in range(k)])
    m2 = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m2[i, j] = m2[j, i] = float(row[f"c{i}_{j}"]) * n
    return n, mean, m2


def partition_moments(d: DataFrame, cols: Sequence[str], weight: str | None = None,
                      design: Callable[[np.ndarray], np.ndarray] | None = None, width: int | None = None
                      ) -> tuple[float, np.ndarray, np.ndarray]:
    """One pass: per-partition weight total, mean and centred cross-product
    matrix (numpy over Arrow batches), combined with the parallel-variance
    formula first by ``MERGE_TASKS`` Spark tasks, then on the driver (which
    gets that many p^2 partials however many partitions there are).
    ``design`` turns rows x ``cols`` into rows x ``width`` columns first."""
    import pandas as pd

    cols = list(cols)
    k = width if design else len(cols)

    def part(it):
        n = 0.0
        mean = np.zeros(k)
        m2 = np.zeros((k, k))
        for pdf in it:
            x = pdf[cols].to_numpy(dtype=float)
            if x.shape[0] == 0:
                continue
            if design:
                x = design(x)
            w = pdf[weight].to_numpy(dtype=float) if weight else np.ones(x.shape[0])
            nb = float(w.sum())
            if nb == 0:
                continue
            mb = (w @ x) / nb
            xc = x - mb
            m2b = (xc * w[:, None]).T @ xc
            delta = mb - mean
            tot = n + nb
            m2 += m2b + np.outer(delta, delta) * (n * nb / tot)
            mean = mean + delta * (nb / tot)
            n = tot
        if n > 0:
            yield pd.DataFrame({"n": [n], "mean": [mean.tolist()], "m2": [m2.ravel().tolist()]})

    def combine(rows):
        n, mean, m2 = 0.0, np.zeros(k), np.zeros((k, k))
        for nb, mb, m2b in rows:
            mb, m2b = np.asarray(mb, dtype=float), np.asarray(m2b, dtype=float).reshape(k, k)
            delta, tot = mb - mean, n + nb
            m2 += m2b + np.outer(delta, delta) * (n * nb / tot)
            mean = mean + delta * (nb / tot)
            n = tot
        return n, mean, m2

    def merge(it):
        n, mean, m2 = combine(r for pdf in it for r in zip(pdf["n"], pdf["mean"], pdf["m2"]))
        if n > 0:
            yield pd.DataFrame({"n": [n], "mean": [mean.tolist()], "m2": [m2.ravel().tolist()]})

    schema = "n double, mean array<double>, m2 array<double>"
    sel = d.select(*cols, *([weight] if weight else []))
    merged = sel.mapInPandas(part, schema).repartition(MERGE_TASKS).mapInPandas(merge, schema)
    return combine((float(r["n"]), r["mean"], r["m2"]) for r in merged.collect())


def compute_gram(df: DataFrame, x: Sequence[str], y: str, weight: str | None = None,
                 assume_complete: bool = False, design: tuple[list[str], Callable[[np.ndarray], np.ndarray]] | None = None) -> Gram:
    """Rows with a NULL in any used column are dropped (complete cases).

    ``assume_complete``: the caller already dropped incomplete rows of the
    inputs the columns derive from (e.g. spline bases of a non-NULL x), so
    the derived expressions are not evaluated a second time in a filter.
    ``design``: names of the predictors and the function that makes them, batch
    by batch, from the columns ``x``.
    """
    x = list(x)
    used = x + [y] + ([weight] if weight else [])
    d = df.select(*[F.col(c).cast("double").alias(c) for c in used])
    if not assume_complete:
        d = d.dropna()
    if design:
        inputs, (x, make) = x, design
        n, means, c = partition_moments(d, inputs + [y], weight, lambda b: np.column_stack([make(b[:, :-1]), b[:, -1]]), len(x) + 1)
    elif weight is None and len(x) + 1 <= JVM_MAX_COLUMNS:
        n, means, c = jvm_moments(d, x + [y])
    else:
        n, means, c = partition_moments(d, x + [y], weight)
    if n == 0:
        raise ValueError("no complete rows")
    p = len(x)
    scale = np.sqrt(np.diag(c)[:p] / n)
    scale[scale == 0] = 1.0
    zz = c[:p, :p] / np.outer(scale, scale)
    zy = c[:p, p] / scale
    return Gram(x, n, np.array(means[:p]), scale, float(means[p]), zz, zy, float(c[p, p]))


def select_full_rank(zz: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Indices of columns kept by a sequential (left-to-right) rank check, as
    R ``lm`` drops later aliased columns."""
    keep: list[int] = []
    for j in range(zz.shape[0]):
        cand = keep + [j]
        sub = zz[np.ix_(cand, cand)]
        diag = zz[j, j]
        if diag <= tol:
            continue
        if keep:
            a = zz[np.ix_(keep, keep)]
            b = zz[np.ix_(keep, [j])]
            resid = diag - float((b.T @ np.linalg.solve(a, b))[0, 0])
        else:
            resid = diag
        if resid / diag > tol:
            keep.append(j)
        del sub
    return keep
