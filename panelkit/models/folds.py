"""Cross-validation from one scan: cross-products per fold, and the moments of
each training set by taking its fold away from the total (ML25).

``training_grams`` centres and scales by the moments of all rows first, so the
subtraction loses no digits; a Gram of any subset of the columns is a slice of
it. Over ``Blocks`` a ``design`` may make the predictors from the columns of each
block, so that only its inputs are kept. ``held_out_errors`` scores every row with the coefficients of the fits that
did not see its fold, all models in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.models.batched import Blocks, sum_over_rows
from panelkit.models.gram import Gram


@dataclass(frozen=True)
class Design:
    """Predictors ``names`` that ``make`` computes from rows x ``inputs``."""
    inputs: list[str]
    names: list[str]
    make: Callable[[np.ndarray], np.ndarray]


def as_design(x: Sequence[str] | Design) -> Design:
    return x if isinstance(x, Design) else Design(list(x), list(x), lambda b: b)


def block_moments(data: Blocks, columns: Sequence[str] | Design) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard deviations (1 for a constant), in a pass each."""
    d = as_design(columns)
    p = len(d.names)
    n, *total = sum_over_rows(data, d.inputs, lambda b: np.concatenate([[len(b)], d.make(b).sum(0)]), 1 + p)
    if not n:
        raise ValueError("no complete rows")
    mean = np.array(total) / n
    square = sum_over_rows(data, d.inputs, lambda b: ((d.make(b) - mean) ** 2).sum(0), p) / n
    return mean, np.array([s if s else 1.0 for s in np.sqrt(square)])


def training_grams(data: DataFrame | Blocks, x: Sequence[str] | Design, y: str, fold: str, n_folds: int) -> list[Gram]:
    """Gram of the rows outside each of the folds 0..n_folds-1 (complete rows)."""
    d = as_design(x)
    x, q, p = d.names, len(d.inputs), len(d.names) + 1
    columns = [*d.inputs, y]

    def whole(b: np.ndarray) -> np.ndarray:
        return np.column_stack([d.make(b[:, :q]), b[:, q]])

    if isinstance(data, Blocks):
        mean, scale = block_moments(data, Design(columns, [*x, y], whole))
    else:
        if q != len(x):
            raise ValueError("a design needs blocks")
        row = data.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
        if row[0] is None:
            raise ValueError("no complete rows")
        mean = np.array(row[:p], dtype=float)
        scale = np.array([s if s else 1.0 for s in row[p:]], dtype=float)

    def block(b: np.ndarray) -> np.ndarray:
        z, of = (whole(b) - mean) / scale, b[:, q + 1]
        out = np.zeros((n_folds, 1 + p + p * p))
        for k in range(n_folds):
            part = z[of == k]
            out[k] = np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
        return out.ravel()

    sums = sum_over_rows(data, [*columns, fold], block, n_folds * (1 + p + p * p)).reshape(n_folds, -1)
    grams = []
    for k in range(n_folds):
        left = sums.sum(axis=0) - sums[k]
        n, s, c = left[0], left[1:1 + p], left[1 + p:].reshape(p, p)
        if n <= 0:
            raise ValueError("a fold holds all rows")
        c = (c - np.outer(s, s) / n) * np.outer(scale, scale)          # centred at the training rows' own means
        means = mean + scale * s / n
        sd = np.sqrt(np.maximum(c.diagonal()[:-1], 0) / n)
        sd[sd <= 1e-12 * scale[:-1]] = 1.0
        grams.append(Gram(x, float(n), means[:-1], sd, float(means[-1]), c[:-1, :-1] / np.outer(sd, sd), c[:-1, -1] / sd, float(c[-1, -1])))
    return grams


def sub_gram(g: Gram, names: Sequence[str]) -> Gram:
    at = [g.names.index(n) for n in names]
    return Gram(list(names), g.n, g.mean[at], g.scale[at], g.ymean, g.zz[np.ix_(at, at)], g.zy[at], g.yy)


def held_out_errors(data: DataFrame | Blocks, x: Sequence[str] | Design, label: str, fold: str, n_folds: int,
                    models: dict[str, tuple[np.ndarray, float]]) -> dict[str, list[float]]:
    """Share of wrong 0/1 predictions per fold and model. A model is a matrix of
    coefficients (folds x intercept and ``x``) and the cut of its linear score."""
    names, d = list(models), as_design(x)

    def block(b: np.ndarray) -> np.ndarray:
        z, y, of = np.column_stack([np.ones(len(b)), d.make(b[:, :-2])]), b[:, -2], b[:, -1].astype(int)
        out = [np.bincount(of, minlength=n_folds)[:n_folds]]
        for coef, cut in models.values():
            miss = ((z * coef[of]).sum(axis=1) >= cut) != (y > 0.5)
            out.append(np.bincount(of, weights=miss, minlength=n_folds)[:n_folds])
        return np.concatenate(out).astype(float)

    sums = sum_over_rows(data, [*d.inputs, label, fold], block, n_folds * (1 + len(names))).reshape(-1, n_folds)
    return {name: (sums[1 + i] / np.maximum(sums[0], 1)).tolist() for i, name in enumerate(names)}
