"""RBF-kernel support vector machines on Nystroem features, all settings of a
grid search trained together (ML19, ML20).

Feature map. ``landmarks`` draws m training rows (a weighted sample by hashed
exponential keys, a top-m over Spark's partial top-m). With K_mm the kernel among
them, k(x, Z) K_mm^-1/2 are features whose dot products approximate the kernel
(Williams & Seeger 2001); distances to the landmarks are computed once per batch
and serve every gamma.

Training. Every (gamma, cost, fold) is a candidate with the objective
|w|^2 / (2 C n) + mean hinge(y f(x)) over the rows outside its fold, the hinge
rounded off over a width of ``SMOOTH`` below the margin so that it has a gradient.
One pass returns loss and gradient of all candidates, two matrix products per
block of rows (of one fold) and gamma, for the candidates that train on the fold;
K_mm^-1/2 is applied to the weights and the gradient on the driver instead of to
every row. The driver steps each candidate (``batched.Descent``), with the points
that a refused step would lead to in the same pass: their margins are linear in the
step. Candidates of fold ``None`` train on all rows, so the
refit of the best setting needs no further pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.models.batched import Blocks, Descent, descend_ahead, in_blocks, sum_over_rows

SMOOTH = 0.1
LANDMARKS = 100
#: points beyond the expected ones that a pass tries on a line
SPARE_POINTS = 2


@dataclass(frozen=True)
class KernelMap:
    points: np.ndarray                   # m x p landmarks
    roots: dict[float, np.ndarray]       # gamma -> K_mm^-1/2

    def distances(self, x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(1)[:, None] + (self.points * self.points).sum(1) - 2 * x @ self.points.T
        return np.maximum(d, 0.0, out=d)

    def signed(self, distances: np.ndarray, gamma: float, y: np.ndarray) -> np.ndarray:
        """One row per input: kernel values of the landmarks and a 1, times ``y``."""
        k = np.empty((len(distances), distances.shape[1] + 1))
        np.multiply(distances, -gamma, out=k[:, :-1])
        np.exp(k[:, :-1], out=k[:, :-1])
        k[:, -1] = 1.0
        k *= y[:, None]
        return k

    def on_landmarks(self, weights: np.ndarray, gamma: float) -> np.ndarray:
        """Weights of ``features`` (one column per machine) as weights of ``signed``."""
        return np.vstack([self.roots[gamma] @ weights[:-1], weights[-1:]])

    def features(self, distances: np.ndarray, gamma: float) -> np.ndarray:
        """One row per input: the mapped features and a 1 for the intercept."""
        z = np.exp(-gamma * distances) @ self.roots[gamma]
        return np.column_stack([z, np.ones(len(z))])


@dataclass(frozen=True)
class KernelMachine:
    columns: list[str]
    kernel: KernelMap
    gamma: float
    cost: float
    weights: np.ndarray
    iterations: int

    def decide(self, x: np.ndarray) -> np.ndarray:
        return self.kernel.features(self.kernel.distances(x), self.gamma) @ self.weights

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``decision`` and ``pred`` (0/1); NULL where a predictor is missing or NaN."""
        shared = df.sparkSession.sparkContext.broadcast(self)      # landmarks x predictors numbers

        @F.pandas_udf("double")
        def decision(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in cols])
            whole = ~np.isnan(x).any(axis=1)
            out = np.full(len(x), np.nan)
            out[whole] = shared.value.decide(x[whole])
            return pd.Series(out)

        out = df.withColumn("decision", decision(*[F.col(c).cast("double") for c in self.columns]))
        out = out.withColumn("decision", F.when(~F.isnan("decision"), F.col("decision")))
        return out.withColumn("pred", (F.col("decision") >= 0).cast("int"))


def landmarks(df: DataFrame, cols: Sequence[str], m: int = LANDMARKS, weight: str | None = None, seed: int = 42) -> np.ndarray:
    """At most ``m`` distinct complete rows, drawn with probability in proportion
    to ``weight`` (equal without one); the same rows whatever the partitioning."""
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).dropna().filter("w > 0")
    names = [f"x{i}" for i in range(len(cols))]
    rows = rows.groupBy(*names).agg(F.sum("w").alias("w"))
    u = (F.pmod(F.xxhash64(*names, F.lit(seed)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    chosen = rows.orderBy(-F.log(u) / F.col("w"), *names).limit(m).select(*names).collect()
    if not chosen:
        raise ValueError("no complete rows")
    return np.array([tuple(r) for r in chosen])


def kernel_map(points: np.ndarray, gammas: Sequence[float]) -> KernelMap:
    roots = {}
    d = np.maximum((points * points).sum(1)[:, None] + (points * points).sum(1) - 2 * points @ points.T, 0.0)
    for g in gammas:
        value, vector = np.linalg.eigh(np.exp(-float(g) * d))
        keep = value > 1e-10 * value.max()
        roots[float(g)] = vector[:, keep] / np.sqrt(value[keep])
    return KernelMap(points, roots)


def hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rounded hinge loss along the rows, and its derivative times ``-SMOOTH``.
    ``margin`` is overwritten."""
    short = np.subtract(1.0, margin, out=margin)
    np.maximum(short, 0.0, out=short)
    near = np.minimum(short, SMOOTH)
    return (np.einsum("ij,ij->i", near, short) - np.einsum("ij,ij->i", near, near) / 2) / SMOOTH, near


@dataclass(frozen=True)
class Setting:
    gamma: float
    cost: float
    fold: int | None                     # left out in training


def train_together(data: Blocks, p: int, kernel: KernelMap, settings: Sequence[Setting], max_iter: int, tol: float
                   ) -> tuple[list[Descent], int, np.ndarray]:
    """Fit every setting on ``data`` (p predictors x0.., y in -1/1, fold). Returns
    the finished runs, the number of passes and the errors made on each setting's
    own fold with that fold's size."""
    columns = [f"x{i}" for i in range(p)] + ["y", "fold"]
    sizes = {int(k): n for k, n in data.counts("fold").items()}
    total = sum(sizes.values())
    gammas = sorted({s.gamma for s in settings})
    width = {g: kernel.roots[g].shape[1] + 1 for g in gammas}
    rows = np.array([total - (sizes.get(s.fold, 0) if s.fold is not None else 0) for s in settings], dtype=float)
    if (rows <= 0).any():
        raise ValueError("a fold holds all rows")
    runs = [Descent(np.zeros(width[s.gamma]), max_iter, tol) for s in settings]

    trains = np.array([-1 if s.fold is None else s.fold for s in settings])
    m = len(kernel.points)

    def evaluate(which: list[int], steps: list[list[float]]) -> list[list[tuple[float, np.ndarray]]]:
        # per gamma: the candidates, their points and directions, the places of their steps in the sums
        plan, at = [], 0
        for g in gammas:
            of = [(j, i) for j, i in enumerate(which) if settings[i].gamma == g]
            if of:
                start = kernel.on_landmarks(np.column_stack([runs[i].theta for _, i in of]), g)
                along = kernel.on_landmarks(np.column_stack([runs[i].direction for _, i in of]), g)
                n = [len(steps[j]) for j, _ in of]
                ends = at + np.cumsum(n)
                plan.append((g, of, start, along, ends - n, ends))
                at = int(ends[-1])

        def lines(fold: float) -> list[tuple]:
            """What the rows of a fold need: per gamma the weights, and for every step of
            the candidates that train on it the candidate, the step and its place."""
            out = []
            for g, of, start, along, first, last in plan:
                keep = [c for c, (_, i) in enumerate(of) if trains[i] != fold]
                if keep:
                    column = np.concatenate([[k] * int(last[c] - first[c]) for k, c in enumerate(keep)]).astype(int)
                    place = np.concatenate([np.arange(first[c], last[c]) for c in keep])
                    step = np.concatenate([steps[of[c][0]] for c in keep])
                    out.append((g, np.hstack([start[:, keep], along[:, keep]]).T, len(keep), column, step[:, None], place))
            return out

        by_fold = {f: lines(f) for f in sizes}

        def block(b: np.ndarray) -> np.ndarray:
            out = np.zeros((at, 2 + m))
            d = kernel.distances(b[:, :p])
            for g, weights, n, column, step, place in by_fold[int(b[0, p + 1])]:
                k = kernel.signed(d, g, b[:, p])
                line = weights @ k.T
                margin = line[n:][column]
                margin *= step
                margin += line[:n][column]
                out[place, 0], near = hinge(margin)
                out[place, 1:] = near @ k
            return out.ravel()

        sums = sum_over_rows(data, columns, block, at * (2 + m)).reshape(at, 2 + m)
        found: list = [None] * len(which)
        for g, of, _, _, first, last in plan:
            for c, (j, i) in enumerate(of):
                told = []
                for row, step in zip(sums[first[c]:last[c]], steps[j]):
                    theta = runs[i].theta + step * runs[i].direction
                    pull = theta / (settings[i].cost * rows[i])
                    pull[-1] = 0.0                              # the intercept is free
                    slope = np.append(row[1:-1] @ kernel.roots[g], row[-1]) / -SMOOTH
                    told.append((row[0] / rows[i] + 0.5 * float(pull @ theta), slope / rows[i] + pull))
                found[j] = told
        return found

    passes = descend_ahead(runs, evaluate, SPARE_POINTS)
    final = [(g, of, kernel.on_landmarks(np.column_stack([runs[i].theta for i in of]), g))
             for g in gammas for of in [[i for i, s in enumerate(settings) if s.gamma == g]]]

    def wrong(b: np.ndarray) -> np.ndarray:
        d, y, fold, out = kernel.distances(b[:, :p]), b[:, p], int(b[0, p + 1]), np.zeros(len(settings))
        for g, of, weights in final:
            judged = [c for c, i in enumerate(of) if trains[i] == fold]
            if judged:
                # a decision of 0 is class 1
                said = kernel.signed(d, g, np.ones(len(d))) @ weights[:, judged] >= 0
                out[[of[c] for c in judged]] = (said != (y > 0)[:, None]).sum(0)
        return out

    errors = sum_over_rows(data, columns, wrong, len(settings))
    held = np.array([sizes.get(s.fold, 0) if s.fold is not None else 0 for s in settings], dtype=float)
    return runs, passes + 1, np.column_stack([errors, held])


def training_rows(df: DataFrame, cols: Sequence[str], label: str, fold: str | None) -> Blocks:
    """Complete rows as x0.., y in -1/1 and fold (0 without one), cached."""
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)],
                     (F.col(label).cast("double") * 2 - 1).alias("y"),
                     (F.col(fold) if fold else F.lit(0)).cast("double").alias("fold")).dropna()
    return in_blocks(rows, rows.columns, by="fold")


def fit(df: DataFrame, cols: Sequence[str], label: str, gamma: float, cost: float, m: int = LANDMARKS, weight: str | None = None,
        max_iter: int = 100, tol: float = 1e-6, seed: int = 42) -> KernelMachine:
    """One machine on all rows of ``df`` (label 0/1)."""
    kernel = kernel_map(landmarks(df, cols, m, weight, seed), [gamma])
    data = training_rows(df, cols, label, None)
    try:
        runs, _, _ = train_together(data, len(cols), kernel, [Setting(float(gamma), float(cost), None)], max_iter, tol)
    finally:
        data.unpersist()
    return KernelMachine(list(cols), kernel, float(gamma), float(cost), runs[0].theta, runs[0].iterations)


def fold_errors(df: DataFrame, cols: Sequence[str], label: str, fold: str, n_folds: int, gamma: float, cost: float, m: int = LANDMARKS,
                max_iter: int = 100, tol: float = 1e-4, seed: int = 42) -> list[float]:
    """Held-out error of one setting on each of the folds 0..n_folds-1."""
    kernel = kernel_map(landmarks(df, cols, m, None, seed), [gamma])
    data = training_rows(df, cols, label, fold)
    try:
        _, _, errors = train_together(data, len(cols), kernel, [Setting(float(gamma), float(cost), k) for k in range(n_folds)], max_iter, tol)
    finally:
        data.unpersist()
    return (errors[:, 0] / np.maximum(errors[:, 1], 1)).tolist()


@dataclass(frozen=True)
class GridSearch:
    rows: list[tuple[float, float, float, int]]      # gamma, cost, mean error over the folds, held-out rows
    best: KernelMachine
    passes: int


def grid_search(df: DataFrame, cols: Sequence[str], label: str, fold: str, gammas: Sequence[float], costs: Sequence[float],
                m: int = LANDMARKS, weight: str | None = None, max_iter: int = 100, tol: float = 1e-4, seed: int = 42) -> GridSearch:
    """Cross-validated error of every (gamma, cost) on fixed folds and the best
    setting (least error, then smallest gamma and cost) fitted on all rows."""
    kernel = kernel_map(landmarks(df, cols, m, weight, seed), gammas)
    data = training_rows(df, cols, label, fold)
    try:
        folds = sorted(int(k) for k in data.counts("fold"))
        settings = [Setting(float(g), float(c), k) for g in gammas for c in costs for k in [*folds, None]]
        runs, passes, errors = train_together(data, len(cols), kernel, settings, max_iter, tol)
    finally:
        data.unpersist()
    rows, refits = [], {}
    for g in gammas:
        for c in costs:
            of = [i for i, s in enumerate(settings) if (s.gamma, s.cost) == (float(g), float(c))]
            cv = [i for i in of if settings[i].fold is not None]
            rows.append((float(g), float(c), float(np.mean(errors[cv, 0] / errors[cv, 1])), int(errors[cv, 1].sum())))
            refits[float(g), float(c)] = next(runs[i] for i in of if settings[i].fold is None)
    g, c, *_ = min(rows, key=lambda r: (r[2], r[0], r[1]))
    return GridSearch(rows, KernelMachine(list(cols), kernel, g, c, refits[g, c].theta, refits[g, c].iterations), passes)
