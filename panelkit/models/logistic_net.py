"""Single-hidden-layer network with one logistic output, entropy loss and
weight decay (ML18, decay variant).

* Objective: cross-entropy + decay * sum(w^2) over all weights (biases
  included), as a p-h-1 logistic network.
* One Spark job returns losses and gradients at several weight vectors: every
  partition runs the forward/backward pass on its Arrow batches with numpy.
* The driver runs BFGS over the weight vector (p*h + 2h + 1 numbers); all trial
  steps of a line search share a job.  ``fit_fold_nets`` trains the networks of
  all cross-validation folds in the same jobs.
* Scoring is a JVM row expression (weights as literals), no Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.models.batched import Blocks, Descent, descend_ahead, spread, sum_over_rows

#: step lengths (1, 0.3, 0.09, ...) tried in one job
TRIAL_STEPS = 5


@dataclass
class LogisticNet:
    features: list[str]
    hidden: int
    weights: np.ndarray
    loss: float
    iterations: int
    converged: bool

    def _unpack(self):
        return unpack(self.weights, len(self.features), self.hidden)

    def probability(self) -> Column:
        w1, b1, w2, b2 = self._unpack()
        out = F.lit(float(b2))
        for j in range(self.hidden):
            z = F.lit(float(b1[j]))
            for i, c in enumerate(self.features):
                z = z + F.lit(float(w1[i, j])) * F.col(c)
            out = out + F.lit(float(w2[j])) / (1 + F.exp(-z))
        return 1 / (1 + F.exp(-out))


def n_weights(p: int, h: int) -> int:
    return p * h + h + h + 1


def unpack(theta: np.ndarray, p: int, h: int):
    w1 = theta[:p * h].reshape(p, h)
    b1 = theta[p * h:p * h + h]
    w2 = theta[p * h + h:p * h + 2 * h]
    b2 = theta[-1]
    return w1, b1, w2, b2


def _sigmoid(z: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-z)); ``z`` is overwritten."""
    np.clip(z, -500, 500, out=z)
    np.negative(z, out=z)
    np.exp(z, out=z)
    z += 1
    return np.divide(1.0, z, out=z)


def _evaluate(data: DataFrame | Blocks, features: list[str], label: str, hidden: int, thetas: np.ndarray, fold: str | None = None,
              leave_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Loss and gradient at every row of ``thetas`` in one job; with ``fold``
    each over the rows outside its entry of ``leave_out``."""
    p, k = len(features), n_weights(len(features), hidden)
    at = np.array(thetas, dtype=float)

    w1 = at[:, :p * hidden].reshape(-1, p, hidden).transpose(0, 2, 1)                 # points x hidden x p
    b1, w2, b2 = at[:, p * hidden:p * hidden + hidden], at[:, -1 - hidden:-1], at[:, -1]

    def block(b: np.ndarray) -> np.ndarray:
        x, y, fold_of = b[:, :p], b[:, p], None if fold is None else b[:, p + 1]
        out = np.zeros((len(at), 1 + k))
        # a block of one fold serves the points that do not leave it out
        alike = fold is not None and (fold_of == fold_of[0]).all()
        use = np.flatnonzero(leave_out != fold_of[0]) if alike else np.arange(len(at))
        if not len(use):
            return out.ravel()
        a = _sigmoid((w1[use].reshape(-1, p) @ x.T).reshape(len(use), hidden, -1) + b1[use][:, :, None])
        o = _sigmoid(np.einsum("ch,chn->cn", w2[use], a) + b2[use][:, None])
        inside = 1.0 if fold is None or alike else (fold_of != leave_out[use][:, None]).astype(float)
        # labels are 0 and 1: one logarithm serves
        likelihood = np.log(np.where(y > 0.5, o, 1 - o) + 1e-12)
        d_out = (o - y) * inside                        # dL/d(logit)
        d_hid = d_out[:, None, :] * w2[use][:, :, None] * a * (1 - a)
        out[use, 0] = -(likelihood * inside).sum(1)
        out[use, 1:1 + p * hidden] = (d_hid.reshape(-1, len(x)) @ x).reshape(len(use), hidden, p).transpose(0, 2, 1).reshape(len(use), -1)
        out[use, 1 + p * hidden:1 + (p + 1) * hidden] = d_hid.sum(2)
        out[use, 1 + (p + 1) * hidden:-1] = np.einsum("chn,cn->ch", a, d_out)
        out[use, -1] = d_out.sum(1)
        return out.ravel()

    columns = [*features, label, *([fold] if fold else [])]
    sums = sum_over_rows(data, columns, block, len(at) * (1 + k)).reshape(len(at), 1 + k)
    return sums[:, 0], sums[:, 1:]


def _objective_job(data: DataFrame, features: list[str], label: str, hidden: int):
    """One-point form of ``_evaluate``."""
    def evaluate(theta: np.ndarray) -> tuple[float, np.ndarray]:
        loss, grad = _evaluate(data, features, label, hidden, theta[None, :])
        return float(loss[0]), grad[0]
    return evaluate


def start_weights(p: int, hidden: int, seed: int, init_range: float) -> np.ndarray:
    return np.random.default_rng(seed).uniform(-init_range, init_range, n_weights(p, hidden))


def fit_fold_nets(data: DataFrame | Blocks, features: Sequence[str], label: str, fold: str, n_folds: int, hidden: int = 3, decay: float = 0.001,
                  max_iter: int = 300, seed: int = 42, init_range: float = 0.7, reltol: float = 1e-8) -> list[Descent]:
    """One network per left-out fold, all trained in the same passes (L-BFGS
    from the same start); ``data`` is complete and cached."""
    features = list(features)
    runs = [Descent(start_weights(len(features), hidden, seed, init_range), max_iter, reltol, memory=60) for _ in range(n_folds)]

    def evaluate(which: list[int], steps: list[list[float]]) -> list[list[tuple[float, np.ndarray]]]:
        at = np.array([runs[i].theta + s * runs[i].direction for i, tried in zip(which, steps) for s in tried])
        loss, grad = _evaluate(data, features, label, hidden, at, fold, np.array([i for i, tried in zip(which, steps) for _ in tried]))
        told = iter(zip(loss + decay * (at * at).sum(axis=1), grad + 2 * decay * at))
        return [[next(told) for _ in tried] for tried in steps]

    descend_ahead(runs, evaluate)
    return runs


def held_out_net_errors(data: DataFrame | Blocks, features: Sequence[str], label: str, fold: str, hidden: int, weights: Sequence[np.ndarray]) -> list[float]:
    """Share of wrong predictions of each network on the fold it did not see."""
    p, n = len(features), len(weights)

    def block(b: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 2))
        for i, theta in enumerate(weights):
            part = b[b[:, p + 1] == i]
            w1, b1, w2, b2 = unpack(theta, p, hidden)
            a = 1 / (1 + np.exp(-np.clip(part[:, :p] @ w1 + b1, -500, 500)))
            out[i] = len(part), ((a @ w2 + b2 >= 0) != (part[:, p] > 0.5)).sum()
        return out.ravel()

    sums = sum_over_rows(data, [*features, label, fold], block, 2 * n).reshape(n, 2)
    return (sums[:, 1] / np.maximum(sums[:, 0], 1)).tolist()


def fit_logistic_net(df: DataFrame, features: Sequence[str], label: str, hidden: int = 3,
                     decay: float = 0.001, max_iter: int = 300, seed: int = 42, init_range: float = 0.7,
                     reltol: float = 1e-8) -> LogisticNet:
    features = list(features)
    data = df.select(*[F.col(c).cast("double") for c in features], F.col(label).cast("double")).dropna()
    data = spread(data).persist()
    try:
        theta = start_weights(len(features), hidden, seed, init_range)
        k = len(theta)

        def f(points):
            loss, g = _evaluate(data, features, label, hidden, points)
            return loss + decay * (points * points).sum(axis=1), g + 2 * decay * points

        fx, gx = (v[0] for v in f(theta[None, :]))
        hinv = np.eye(k)
        converged = False
        it = 0
        for it in range(1, max_iter + 1):
            d = -hinv @ gx
            if gx @ d >= 0:          # not a descent direction: reset
                hinv = np.eye(k)
                d = -gx
            # all trial steps in one job; where none will do, shorter ones in another
            steps, accepted = 0.3 ** np.arange(TRIAL_STEPS), False
            for _ in range(30 // TRIAL_STEPS):
                values, grads = f(theta + steps[:, None] * d)
                for step, fc, gc in zip(steps, values, grads):
                    if fc <= fx + 1e-4 * step * (gx @ d):
                        cand, accepted = theta + step * d, True
                        break
                if accepted:
                    break
                steps = steps * 0.3 ** TRIAL_STEPS
            if not accepted:
                break
            s, yv = cand - theta, gc - gx
            sy = float(s @ yv)
            if sy > 1e-12:
                rho = 1.0 / sy
                ident = np.eye(k)
                hinv = (ident - rho * np.outer(s, yv)) @ hinv @ (ident - rho * np.outer(yv, s)) \
                    + rho * np.outer(s, s)
            done = abs(fx - fc) <= reltol * (abs(fx) + reltol)
            theta, fx, gx = cand, fc, gc
            if done:
                converged = True
                break
        return LogisticNet(features, hidden, theta, fx, it, converged)
    finally:
        data.unpersist()


def score(net: LogisticNet, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Probability and 0/1 prediction (``prob >= threshold``)."""
    return df.withColumn("prob", net.probability()).withColumn(
        "pred", (F.col("prob") >= threshold).cast("int"))
