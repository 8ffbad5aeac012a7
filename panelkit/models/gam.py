"""Additive model with penalised cubic regression splines (ML14-ML17).

Each smooth term is a cubic B-spline basis on equally spaced knots (k basis
columns; ``basis_matrix`` makes them from a batch's values, ``add_basis`` as column
expressions) with a second-order difference
penalty (P-splines, Eilers & Marx 1996).  One distributed Gram pass over
[parametric columns, all basis columns] is the only row work (Spark sends the
values, the batch makes its columns); fitted values are one cubic a smooth and
row, read off by the cell between two knots (``GamFit.fitted``); smoothing
parameters are chosen by GCV on the driver from that Gram alone (Newton steps
on the log parameters of all smooths at once, with the exact gradient and
Hessian of log GCV), and edf = tr((X'X+S)^-1 X'X).

This approximates, and does not reproduce, a thin-plate/REML smoother: the
basis and the criterion differ, the reported quantities (edf per smooth,
effects with pointwise SE bands, % effects of parametric terms) are the same
kind.  One basis column per smooth is dropped for identifiability with the
intercept (the B-splines sum to one).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions import dists
from panelkit.models.batched import sum_over_rows
from panelkit.models.gram import Gram, compute_gram


def _cardinal_cubic(u: Column) -> Column:
    """Uniform cubic B-spline on [0, 4) in the local coordinate u, as the
    fourth difference of truncated cubes: (1/6) sum_i (-1)^i C(4,i) (u-i)_+^3."""
    terms = None
    for i, c in enumerate((1, -4, 6, -4, 1)):
        over = F.greatest(u - F.lit(float(i)), F.lit(0.0))
        t = F.lit(c / 6.0) * over * over * over
        terms = t if terms is None else terms + t
    return F.when(u < 4, terms).otherwise(F.lit(0.0))


def _cardinal_slope(u: Column) -> Column:
    """Derivative of ``_cardinal_cubic``."""
    terms = None
    for i, c in enumerate((1, -4, 6, -4, 1)):
        over = F.greatest(u - F.lit(float(i)), F.lit(0.0))
        t = F.lit(c / 2.0) * over * over
        terms = t if terms is None else terms + t
    return F.when(u < 4, terms).otherwise(F.lit(0.0))


#: the four pieces of a cubic B-spline as coefficients of 1, t, t^2, t^3 within a cell
PIECES = np.array([[1, -3, 3, -1], [4, 0, -6, 3], [1, 3, 3, -3], [0, 0, 0, 1]]) / 6.0


def basis_matrix(x: np.ndarray, lo: float, hi: float, k: int) -> np.ndarray:
    """Rows x the k - 1 design columns of a smooth (the first spline is dropped)."""
    u = (np.clip(x, lo, hi) - lo) / _knot_step(lo, hi, k)
    cell = np.minimum(u.astype(int), k - 4)
    t = u - cell
    powers = np.stack([np.ones_like(t), t, t * t, t * t * t])
    out = np.zeros((len(x), k))
    row = np.arange(len(x))
    for i, values in enumerate(PIECES @ powers):
        out[row, cell + i] = values
    return out[:, 1:]


def design_matrix(smooths: dict) -> Callable[[np.ndarray], np.ndarray]:
    """Function from the smoothed columns (rows x smooths) to the design columns of all smooths."""
    terms = [(lo, hi, k) for _col, lo, hi, k, _names in smooths.values()]
    return lambda b: np.hstack([basis_matrix(b[:, i], *term) for i, term in enumerate(terms)])


def _knot_step(lo: float, hi: float, k: int) -> float:
    return (hi - lo) / (k - 3) if hi > lo else 1.0


def _local_coordinate(x: Column, lo: float, hi: float, k: int) -> Column:
    """(clamped x - lo) / knot spacing; basis j uses u - j + 3."""
    return (F.least(F.greatest(x.cast("double"), F.lit(lo)), F.lit(hi)) - F.lit(lo)) / F.lit(_knot_step(lo, hi, k))


def _total(terms: Sequence[Column]) -> Column:
    """Sum by halves, so that the expression stays shallow however many terms."""
    if not terms:
        return F.lit(0.0)
    if len(terms) == 1:
        return terms[0]
    return _total(terms[:len(terms) // 2]) + _total(terms[len(terms) // 2:])


def difference_penalty(k: int, order: int = 2) -> np.ndarray:
    d = np.diff(np.eye(k), n=order, axis=0)
    return d.T @ d


@dataclass
class GamFit:
    parametric: list[str]
    smooths: dict          # name -> (column, lo, hi, k, [design column names])
    names: list[str]
    coef: np.ndarray       # raw-scale coefficients for names
    intercept: float
    vb: np.ndarray         # Bayesian covariance of the z-scale coefficients (incl. intercept first)
    mean: np.ndarray
    scale: np.ndarray
    ymean: float
    n: float
    sigma2: float
    edf_total: float
    edf: dict
    lambdas: dict
    gcv: float

    def design(self, df: DataFrame) -> DataFrame:
        return add_basis(df, self.smooths, extend=True)

    def predict(self) -> Column:
        eta = F.lit(self.intercept)
        for nm, b in zip(self.names, self.coef):
            eta = eta + F.lit(float(b)) * F.col(nm)
        return eta

    def fitted(self) -> Column:
        """``predict`` from the smoothed columns themselves instead of ``design``: per smooth
        the cubic of the value's cell, its tangent outside the fitted range."""
        eta = F.lit(self.intercept)
        coef = dict(zip(self.names, self.coef))
        for nm in self.parametric:
            eta = eta + F.lit(float(coef[nm])) * F.col(nm)
        for col, lo, hi, k, names in self.smooths.values():
            b = np.array([0.0, *[coef[nm] for nm in names]])
            cubics = np.array([b[c:c + 4] @ PIECES for c in range(k - 3)])
            u = _local_coordinate(F.col(col), lo, hi, k)
            cell = F.least(F.floor(u), F.lit(k - 4)).cast("int")
            beyond = (F.col(col).cast("double") - F.lit(lo)) / F.lit(_knot_step(lo, hi, k)) - u      # 0 inside the range
            t = u - cell
            a0, a1, a2, a3 = (F.get(F.array(*[F.lit(float(v)) for v in cubics[:, j]]), cell) for j in range(4))
            eta = eta + a0 + t * (a1 + t * (a2 + t * a3)) + beyond * (a1 + t * (2 * a2 + 3 * t * a3))
        return eta

    def predict_se(self) -> Column:
        """Pointwise SE of the linear predictor from the z-scale covariance."""
        zs = [F.lit(1.0)] + [(F.col(nm) - F.lit(float(m))) / F.lit(float(s))
                             for nm, m, s in zip(self.names, self.mean, self.scale)]
        rows = [_total([F.lit(float(c)) * z for c, z in zip(self.vb[i], zs) if c != 0]) * zs[i] for i in range(len(zs))]
        return F.sqrt(F.greatest(_total(rows), F.lit(0.0)))

    def penalty_slope(self) -> dict[str, float]:
        """Per design column the penalty's side of the score equations,
        lambda (S coef)_j: the sum of residual times column equals it (0 for parametric ones)."""
        out = dict.fromkeys(self.names, 0.0)
        for c, (_col, _lo, _hi, k, names) in self.smooths.items():
            b = np.array([self.coef[self.names.index(nm)] for nm in names])
            out.update(zip(names, (self.lambdas[c] * (difference_penalty(k)[1:, 1:] @ b)).tolist()))
        return out

    def parametric_rows(self) -> list[tuple]:
        """(term, estimate, std_error, pct_change) with % effect = (exp(b)-1)*100."""
        out = []
        for t in self.parametric:
            i = self.names.index(t)
            se = float(np.sqrt(self.vb[i + 1, i + 1])) / float(self.scale[i])
            b = float(self.coef[i])
            out.append((t, b, se, float((np.exp(b) - 1) * 100)))
        return out


#: log smoothing parameters stay within these; a straight-line effect has its optimum at the upper one
LOG_LAMBDA = (float(np.log(1e-6)), float(np.log(1e9)))


def log_gcv(g: Gram, penalties: Sequence[np.ndarray], rho: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """log GCV at the log smoothing parameters ``rho`` with its gradient and Hessian.

    ``penalties`` are p x p. With V = (Z'Z + sum P_j)^-1 and P_j = exp(rho_j) S_j:
    d beta_j = -V P_j beta, and the residual sum and tr(V Z'Z) follow from it."""
    m = len(penalties)
    parts = [np.exp(r) * q for r, q in zip(rho, penalties)]
    total = sum(parts)
    v = np.linalg.pinv(g.zz + total)
    beta = v @ g.zy
    vg = v @ g.zz
    vp = [v @ q for q in parts]
    # an exact fit leaves rounding only
    rss = max(float(g.yy - 2 * beta @ g.zy + beta @ g.zz @ beta), float(np.finfo(float).eps * max(g.yy, 1e-300)))
    room = float(g.n - np.trace(vg) - 1.0)
    slope = -total @ beta                                    # half the derivative of the residual sum by beta
    d_beta = [-w @ beta for w in vp]
    d_rss = np.array([2 * slope @ b for b in d_beta])
    d_edf = np.array([-np.sum(w * vg.T) for w in vp])
    dd_rss, dd_edf = np.empty((m, m)), np.empty((m, m))
    for j in range(m):
        for k in range(m):
            dd_beta = -vp[k] @ d_beta[j] - vp[j] @ d_beta[k] + (d_beta[j] if j == k else 0)
            dd_rss[j, k] = 2 * d_beta[k] @ g.zz @ d_beta[j] + 2 * slope @ dd_beta
            dd_edf[j, k] = np.sum((vp[k] @ vp[j]) * vg.T) + np.sum((vp[j] @ vp[k]) * vg.T) + (d_edf[j] if j == k else 0)
    value = float(np.log(g.n) + np.log(rss) - 2 * np.log(room))
    grad = d_rss / rss + 2 * d_edf / room
    hess = dd_rss / rss - np.outer(d_rss, d_rss) / rss ** 2 + 2 * dd_edf / room + 2 * np.outer(d_edf, d_edf) / room ** 2
    return value, grad, hess


def newton_gcv(g: Gram, penalties: Sequence[np.ndarray], start: np.ndarray, max_iter: int = 60, tol: float = 1e-9) -> tuple[float, np.ndarray]:
    """(log GCV, log parameters) where Newton's steps from ``start`` end: the
    gradient is 0, or points out of ``LOG_LAMBDA``. Directions of negative
    curvature are turned downhill, steps are halved until they descend."""
    lo, hi = LOG_LAMBDA
    rho = np.clip(np.asarray(start, dtype=float), lo, hi)
    value, grad, hess = log_gcv(g, penalties, rho)
    for _ in range(max_iter):
        free = ~(((rho <= lo) & (grad > 0)) | ((rho >= hi) & (grad < 0)))
        if not free.any() or np.abs(grad[free]).max() < tol:
            break
        w, q = np.linalg.eigh(hess[np.ix_(free, free)])
        step = np.zeros(len(rho))
        step[free] = -q @ ((q.T @ grad[free]) / np.maximum(np.abs(w), 1e-12))
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-300))
        for _half in range(40):
            trial = np.clip(rho + step, lo, hi)
            found = log_gcv(g, penalties, trial)
            if found[0] < value:
                break
            step = step / 2
        else:
            break
        rho, (value, grad, hess) = trial, found
    return value, rho


def add_basis(df: DataFrame, smooths: dict, extend: bool = False) -> DataFrame:
    """Append the design columns of every smooth.  The local coordinate is a
    separate projection so each row computes it once per smooth.  With
    ``extend`` (for scoring) the basis continues as its tangent outside the
    fitted range, so predictions go on linearly there."""
    ucols = {f"_u_{name}": _local_coordinate(F.col(col), lo, hi, k)
             for name, (col, lo, hi, k, _names) in smooths.items()}
    if extend:
        ucols |= {f"_e_{name}": (F.col(col).cast("double") - F.lit(lo)) / F.lit(_knot_step(lo, hi, k)) - _local_coordinate(F.col(col), lo, hi, k)
                  for name, (col, lo, hi, k, _names) in smooths.items()}
    out = df.withColumns(ucols)
    cols = {}
    for name, (_col, _lo, _hi, _k, names) in smooths.items():
        u = F.col(f"_u_{name}")
        for j, nm in enumerate(names, start=1):
            at = u - F.lit(float(j - 3))
            cols[nm] = _cardinal_cubic(at)
            if extend:
                cols[nm] = cols[nm] + F.col(f"_e_{name}") * _cardinal_slope(at)     # 0 inside the range
    return out.withColumns(cols).drop(*ucols)


def smooth_terms(d: DataFrame, smooth_cols: Sequence[str], k: int) -> dict:
    """Range and design columns of each smooth, over the rows of ``d``."""
    rng = d.agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(smooth_cols)],
                *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(smooth_cols)]).collect()[0]
    return {c: (c, float(rng[f"lo_{i}"]), float(rng[f"hi_{i}"]), k, [f"s_{c}_{j}" for j in range(1, k)]) for i, c in enumerate(smooth_cols)}


def fit_gam(df: DataFrame, y: str, smooth_cols: Sequence[str], parametric: Sequence[str] = (),
            k: int = 10, lambda_grid: Sequence[float] | None = None, rounds: int = 3,
            lambdas: dict | None = None) -> GamFit:
    """Fit; smoothing parameters by GCV unless fixed via ``lambdas``; with a
    ``lambda_grid`` by ``rounds`` of a coordinate search on it."""
    smooth_cols = list(smooth_cols)
    parametric = list(parametric)
    d = df.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys(smooth_cols + parametric + [y])]).dropna()
    smooths = smooth_terms(d, smooth_cols, k)
    names, make, p = parametric + [nm for s in smooths.values() for nm in s[4]], design_matrix(smooths), len(parametric)
    g = compute_gram(d, parametric + smooth_cols, y, assume_complete=True,
                     design=(names, lambda b: np.hstack([b[:, :p], make(b[:, p:])])))
    return gam_from_gram(g, smooths, parametric, lambda_grid, rounds, lambdas)


def gam_from_gram(g: Gram, smooths: dict, parametric: Sequence[str], lambda_grid: Sequence[float] | None = None, rounds: int = 3,
                  lambdas: dict | None = None) -> GamFit:
    """The fit from the cross-products of the parametric and basis columns (no pass over rows)."""
    names, parametric = list(g.names), list(parametric)
    p = len(names)
    k = next(iter(smooths.values()))[3]
    blocks = {}
    s_full = difference_penalty(k)[1:, 1:]
    for c, s in smooths.items():
        idx = [names.index(nm) for nm in s[4]]
        sz = s_full / np.outer(g.scale[idx], g.scale[idx])
        blocks[c] = (idx, sz)
    lam = {c: 1.0 for c in smooths}

    def solve(lams):
        pen = np.zeros((p, p))
        for c, (idx, sz) in blocks.items():
            pen[np.ix_(idx, idx)] += lams[c] * sz
        a = g.zz + pen
        inv = np.linalg.pinv(a)
        beta = inv @ g.zy
        rss = g.yy - 2 * beta @ g.zy + beta @ g.zz @ beta
        fmat = inv @ g.zz
        edf = float(np.trace(fmat)) + 1.0
        gcv = g.n * rss / (g.n - edf) ** 2
        return gcv, beta, inv, fmat, rss, edf

    if lambdas is not None:
        lam = {c: float(lambdas[c]) for c in smooths}
    elif lambda_grid is None:
        full = []
        for idx, sz in blocks.values():
            full.append(np.zeros((p, p)))
            full[-1][np.ix_(idx, idx)] = sz
        # GCV may have several minima: Newton from the best of a few common starts and from the middle
        starts = sorted(np.linspace(np.log(1e-3), np.log(1e6), 7), key=lambda r: log_gcv(g, full, np.full(len(full), r))[0])
        found = [newton_gcv(g, full, np.full(len(full), r)) for r in (*starts[:3], 0.0)]
        rho = min(found, key=lambda x: x[0])[1]
        lam = {c: float(np.exp(r)) for c, r in zip(blocks, rho)}
    best = solve(lam)[0]
    for _ in range(0 if lambdas is not None or lambda_grid is None else rounds):
        for c in smooths:
            for v in lambda_grid:
                trial = dict(lam, **{c: v})
                score = solve(trial)[0]
                if score < best - 1e-12:
                    best, lam = score, trial
    gcv, beta, inv, fmat, rss, edf_total = solve(lam)
    sigma2 = rss / (g.n - edf_total)
    vb = np.zeros((p + 1, p + 1))
    vb[0, 0] = sigma2 / g.n
    vb[1:, 1:] = sigma2 * inv
    coef = beta / g.scale
    intercept = g.ymean - float(coef @ g.mean)
    edf = {c: float(np.trace(fmat[np.ix_(idx, idx)])) for c, (idx, _s) in blocks.items()}
    return GamFit(parametric, smooths, names, coef, intercept, vb, g.mean, g.scale, g.ymean, g.n,
                  float(sigma2), edf_total, edf, lam, float(gcv))


def score_sums(df: DataFrame, fit: GamFit, y: str) -> tuple[float, float, float, np.ndarray]:
    """One pass: the number of rows with all predictors and the sum of their fitted values,
    the number of those that have ``y`` and their sums of residual times 1 and every design column."""
    inputs = [*fit.parametric, *[s[0] for s in fit.smooths.values()]]
    p, make, beta = len(fit.parametric), design_matrix(fit.smooths), np.concatenate([[fit.intercept], fit.coef])

    def block(b: np.ndarray) -> np.ndarray:
        b = b[~np.isnan(b[:, :-1]).any(axis=1)]
        x = np.column_stack([np.ones(len(b)), b[:, :p], make(b[:, p:-1])])
        found = x @ beta
        known = ~np.isnan(b[:, -1])
        return np.concatenate([[len(b), found.sum(), known.sum()], x[known].T @ (b[known, -1] - found[known])])

    sums = sum_over_rows(df.select(*[F.col(c).cast("double") for c in [*inputs, y]]), [*inputs, y], block, 3 + len(beta))
    return float(sums[0]), float(sums[1]), float(sums[2]), sums[3:]


def effect_grid(spark: SparkSession, fit: GamFit, term: str, n: int = 50,
                fixed: dict | None = None, level: float = 0.95,
                factor: tuple[str, dict] | None = None) -> DataFrame:
    """Prediction grid over one smooth's range (other terms at the values of
    ``fixed``: their medians or reference levels; without one, smooths at
    mid-range and parametric columns at their means), with
    pointwise SE and a back-transformed band (exp scale).

    ``factor = (name, {level: {dummy column: value}})`` crosses the sequence
    with the factor's levels (n x levels rows, both bounded by construction).
    """
    col, lo, hi, _k, _names = fit.smooths[term]
    base = {c: float(m) for c, m in zip(fit.names, fit.mean)}
    raw_fixed = {}
    for c, (cc, *_rest) in fit.smooths.items():
        if c != term:
            raw_fixed[cc] = (fixed or {}).get(cc, _mid_range(fit, c))
    for c in fit.parametric:
        raw_fixed[c] = (fixed or {}).get(c, base[c])
    g = spark.range(n).select((F.lit(lo) + F.col("id") * F.lit((hi - lo) / max(n - 1, 1))).alias(col))
    keep = [F.col(col).alias("x")]
    if factor is not None:
        fname, levels = factor
        dummies = sorted({d for m in levels.values() for d in m})
        lv = spark.createDataFrame([(str(k), *[float(m.get(d, 0.0)) for d in dummies]) for k, m in levels.items()],
                                   ", ".join([f"`{fname}` string"] + [f"`{d}` double" for d in dummies]))
        for d in dummies:
            raw_fixed.pop(d, None)
        g = g.crossJoin(F.broadcast(lv))
        keep.append(F.col(fname))
    g = g.withColumns({c: F.lit(v) for c, v in raw_fixed.items()})
    g = add_basis(g, fit.smooths)
    q = dists.norm_ppf(0.5 + level / 2)
    out = g.select(*keep, fit.predict().alias("fit"), fit.predict_se().alias("se"))
    return out.withColumns({"lower": F.col("fit") - q * F.col("se"), "upper": F.col("fit") + q * F.col("se")}) \
        .withColumns({"fit_exp": F.exp("fit"), "lower_exp": F.exp("lower"), "upper_exp": F.exp("upper")})


def _mid_range(fit: GamFit, term: str) -> float:
    _col, lo, hi, _k, _n = fit.smooths[term]
    return (lo + hi) / 2.0
