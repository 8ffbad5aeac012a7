"""Newton (iteratively reweighted least squares) fits of Poisson-log and
binomial-logit models, several at a time (ML8, ML12, ML25).

One pass returns, per candidate, the score vector, the information matrix (a
weighted cross-product), deviance, Pearson chi^2 and log likelihood at its
present coefficients; candidates differ in the fold that they leave out. The
driver solves (p + 1) x (p + 1) systems. The first pass stands at the null model,
so its deviance is the null deviance; the last one is at the result, so nothing
is computed again for the summary. A step that raises the deviance is halved.
Predictors are centred and scaled by the caller's moments, and the coefficients
turned back at the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.models.batched import Blocks, sum_over_rows

#: a linear predictor beyond this gives a fitted probability of 0 or 1
EXTREME = 25.0
MAX_HALVINGS = 30


@dataclass
class NewtonFit:
    coef: np.ndarray              # intercept first, raw scale
    cov: np.ndarray
    n: float
    deviance: float
    null_deviance: float
    pearson: float
    loglik: float
    iterations: int
    converged: bool
    separated: bool


def _xlog(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a log(a / b), 0 where a is 0."""
    return np.where(a > 0, a * np.log(np.where(a > 0, a, 1.0) / b), 0.0)


def _log_factorial(y: np.ndarray) -> np.ndarray:
    values, at = np.unique(y, return_inverse=True)
    return np.array([math.lgamma(v + 1) for v in values])[at]


def _response(family: str, y: np.ndarray, eta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, unit deviance and log likelihood (rows x candidates)."""
    y = y[:, None]
    if family == "poisson":
        mu = np.exp(np.clip(eta, -700, 700))
        return mu, 2 * (_xlog(y, mu) - (y - mu)), y * eta - mu - _log_factorial(y[:, 0])[:, None]
    mu = np.clip(1 / (1 + np.exp(-np.clip(eta, -700, 700))), 1e-300, 1 - 1e-16)
    whole = np.rint(y)
    return mu, 2 * (_xlog(y, mu) + _xlog(1 - y, 1 - mu)), whole * np.log(mu) + (1 - whole) * np.log1p(-mu)


def newton(data: DataFrame | Blocks, y: str, x: Sequence[str], family: str, mean: np.ndarray, scale: np.ndarray, offset: str | None = None,
           fold: str | None = None, leave_out: Sequence[int | None] = (None,), max_iter: int = 50, tol: float = 1e-11) -> list[NewtonFit]:
    """One fit per entry of ``leave_out`` (a fold, or None for all rows) on the
    complete rows of ``data``, which should be cached."""
    x, p, many = list(x), len(x) + 1, len(leave_out)
    columns = [*x, y, *([offset] if offset else []), *([fold] if fold else [])]
    out = np.array([-1 if k is None else k for k in leave_out])
    exposure = F.exp(F.col(offset)) if offset else F.lit(1.0)
    if isinstance(data, Blocks):
        if offset or not fold:
            raise ValueError("blocks are for fits over folds, without an offset")
        size = data.counts(fold)
        kinds = list(size)
        total = sum_over_rows(data, [y, fold], lambda b: np.array([b[b[:, 1] == k, 0].sum() for k in kinds]), len(kinds))
        parts = [(k, size[k], t, size[k]) for k, t in zip(kinds, total)]
    else:
        parts = data.groupBy(F.col(fold) if fold else F.lit(0).alias("fold")).agg(
            F.count(F.lit(1)), F.sum(y), F.sum(exposure)).collect()
    sums = {int(r[0]): np.array([float(r[1]), float(r[2]), float(r[3])]) for r in parts}
    if not sums:
        raise ValueError("no complete rows")
    null = sum(sums.values()) - np.array([sums.get(k, np.zeros(3)) if k >= 0 else np.zeros(3) for k in out])
    rate = np.maximum(null[:, 1], 1e-10) / np.maximum(null[:, 2], 1e-300)
    beta = np.zeros((many, p))
    beta[:, 0] = np.log(rate) if family == "poisson" else np.log(np.clip(rate, 1e-10, 1 - 1e-10) / (1 - np.clip(rate, 1e-10, 1 - 1e-10)))
    width = 4 + p + p * p

    def evaluate(which: np.ndarray, at: np.ndarray) -> np.ndarray:
        def block(b: np.ndarray) -> np.ndarray:
            z = np.column_stack([np.ones(len(b)), (b[:, :p - 1] - mean) / scale])
            eta = z @ at.T + (b[:, p][:, None] if offset else 0.0)
            mu, dev, lik = _response(family, b[:, p - 1], eta)
            inside = b[:, -1][:, None] != out[which] if fold else np.ones_like(eta, dtype=bool)
            w = mu if family == "poisson" else mu * (1 - mu)
            left = (b[:, p - 1][:, None] - mu) * inside
            pearson = left * left / np.maximum(w, 1e-300)
            far = (np.abs(eta) > EXTREME) & inside
            rows = []
            for c in range(len(which)):
                info = (z * (w[:, c] * inside[:, c])[:, None]).T @ z
                rows.append(np.concatenate([[(dev[:, c] * inside[:, c]).sum(), pearson[:, c].sum(), (lik[:, c] * inside[:, c]).sum(),
                                             far[:, c].sum()], z.T @ left[:, c], info.ravel()]))
            return np.concatenate(rows)
        return sum_over_rows(data, columns, block, width * len(which)).reshape(len(which), width)

    state = evaluate(np.arange(many), beta)
    null_deviance = state[:, 0].copy()
    step = np.zeros_like(beta)
    halvings, rounds, done, good = np.zeros(many, dtype=int), np.zeros(many, dtype=int), np.zeros(many, dtype=bool), np.zeros(many, dtype=bool)
    for c in range(many):
        step[c] = np.linalg.pinv(state[c, 4 + p:].reshape(p, p)) @ state[c, 4:4 + p]
    while not done.all():
        which = np.flatnonzero(~done)
        trial = beta[which] + step[which]
        found = evaluate(which, trial)
        for k, c in enumerate(which):
            before, after = state[c, 0], found[k, 0]
            if not np.isfinite(found[k]).all() or after > before * (1 + 1e-9) + 1e-9:
                step[c] /= 2
                halvings[c] += 1
                done[c] = halvings[c] > MAX_HALVINGS
                continue
            beta[c], state[c], halvings[c] = trial[k], found[k], 0
            rounds[c] += 1
            settled = abs(before - after) <= tol * (abs(after) + 0.1) and np.abs(step[c]).max() <= 1e-6 * (1 + np.abs(beta[c]).max())
            good[c] = settled
            done[c] = settled or rounds[c] >= max_iter
            step[c] = np.linalg.pinv(state[c, 4 + p:].reshape(p, p)) @ state[c, 4:4 + p]
    back = np.eye(p)
    back[0, 1:], back[1:, 1:] = -mean / scale, np.diag(1 / scale)
    fits = []
    for c in range(many):
        separated = family == "binomial" and state[c, 3] > 0
        cov = back @ np.linalg.pinv(state[c, 4 + p:].reshape(p, p)) @ back.T
        fits.append(NewtonFit(back @ beta[c], cov, float(null[c, 0]), float(state[c, 0]), float(null_deviance[c]), float(state[c, 1]),
                              float(state[c, 2]), int(rounds[c]), bool(good[c]) and not separated, bool(separated)))
    return fits
