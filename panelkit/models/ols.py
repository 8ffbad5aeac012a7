"""Ordinary least squares from a distributed Gram matrix (ML1-ML7, ML27).

Only the Gram pass touches rows; coefficients, standard errors, t/F tests,
VIFs and confidence intervals are p x p driver arithmetic.  Scoring and
per-row diagnostics (fitted, residual, leverage, Cook's distance) are
column expressions with the coefficients as literals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions import dists
from panelkit.models.gram import Gram, compute_gram, select_full_rank

INTERCEPT = "(Intercept)"


@dataclass
class LinearFit:
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    sigma: float
    n: float
    df_resid: float
    rss: float
    tss: float
    aliased: list[str] = field(default_factory=list)

    @property
    def r2(self) -> float:
        return 1.0 - self.rss / self.tss if self.tss > 0 else float("nan")

    @property
    def adj_r2(self) -> float:
        k = len(self.terms) - 1
        return 1.0 - (1.0 - self.r2) * (self.n - 1) / self.df_resid if self.df_resid > 0 else float("nan")

    @property
    def f_stat(self) -> float:
        k = len(self.terms) - 1
        if k == 0 or self.rss <= 0:
            return float("nan")
        return ((self.tss - self.rss) / k) / (self.rss / self.df_resid)

    @property
    def f_p_value(self) -> float:
        return dists.f_sf(self.f_stat, len(self.terms) - 1, self.df_resid)

    @property
    def rmse(self) -> float:
        return float(np.sqrt(self.rss / self.n))

    def se(self) -> np.ndarray:
        return np.sqrt(np.diag(self.cov))

    def coef_rows(self, level: float = 0.95, t_mult: float | None = None) -> list[tuple]:
        se = self.se()
        q = t_mult if t_mult is not None else dists.t_ppf(0.5 + level / 2.0, self.df_resid)
        rows = []
        for t, b, s in zip(self.terms, self.coef, se):
            tv = b / s if s > 0 else float("nan")
            rows.append((t, float(b), float(s), float(tv),
                         float(dists.t_two_sided_p(float(tv), float(self.df_resid))),
                         float(b - q * s), float(b + q * s)))
        return rows

    def coef_table(self, spark: SparkSession, level: float = 0.95) -> DataFrame:
        return spark.createDataFrame(
            self.coef_rows(level),
            "term string, estimate double, std_error double, t_value double, p_value double, "
            "conf_low double, conf_high double")

    def summary_row(self) -> dict:
        return {"n": self.n, "r2": self.r2, "adj_r2": self.adj_r2, "sigma": self.sigma,
                "f_stat": self.f_stat, "f_p_value": self.f_p_value, "df_resid": self.df_resid,
                "rmse": self.rmse}

    def predict(self) -> Column:
        expr = F.lit(float(self.coef[0]))
        for t, b in zip(self.terms[1:], self.coef[1:]):
            expr = expr + F.lit(float(b)) * F.col(t)
        return expr

    def leverage(self) -> Column:
        """h_i = x_i' (X'X)^-1 x_i with x = (1, predictors)."""
        m = self.cov / (self.sigma ** 2)
        xs = [F.lit(1.0)] + [F.col(t) for t in self.terms[1:]]
        expr = None
        k = len(xs)
        for i in range(k):
            for j in range(i, k):
                coef = m[i, i] if i == j else 2 * m[i, j]
                term = F.lit(float(coef)) * xs[i] * xs[j]
                expr = term if expr is None else expr + term
        return expr


def ols_from_gram(g: Gram) -> LinearFit:
    keep = select_full_rank(g.zz)
    aliased = [g.names[i] for i in range(g.p) if i not in keep]
    zz = g.zz[np.ix_(keep, keep)]
    zy = g.zy[keep]
    k = len(keep)
    inv = np.linalg.inv(zz) if k else np.zeros((0, 0))
    bz = inv @ zy if k else np.zeros(0)
    rss = max(g.yy - float(bz @ zy), 0.0) if k else g.yy
    df_resid = g.n - (k + 1)
    sigma2 = rss / df_resid if df_resid > 0 else float("nan")
    mean = g.mean[keep]
    scale = g.scale[keep]
    beta = bz / scale
    b0 = g.ymean - float(beta @ mean)
    a = np.zeros((k + 1, k + 1))
    a[0, 0] = 1.0
    a[0, 1:] = -mean / scale
    a[1:, 1:] = np.diag(1.0 / scale)
    phi_cov = np.zeros((k + 1, k + 1))
    phi_cov[0, 0] = sigma2 / g.n
    phi_cov[1:, 1:] = sigma2 * inv
    cov = a @ phi_cov @ a.T
    terms = [INTERCEPT] + [g.names[i] for i in keep]
    return LinearFit(terms, np.concatenate([[b0], beta]), cov, float(np.sqrt(sigma2)), g.n, df_resid,
                     rss, g.yy, aliased)


def fit_ols(df: DataFrame, y: str, x: Sequence[str], weight: str | None = None) -> LinearFit:
    return ols_from_gram(compute_gram(df, x, y, weight))


def factor_fit(df: DataFrame, y: str, factor: str) -> tuple[int, int, float]:
    """(rows, levels, R^2) of y on one factor: between-level over total sum of
    squares, from one aggregate per level (a hot level is a partial aggregate)."""
    d = df.select(F.col(factor).alias("_g"), F.col(y).cast("double").alias("_y")).dropna()
    per = d.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m"), F.var_pop("_y").alias("v"))
    total = d.agg(F.avg("_y").alias("mean"), F.var_pop("_y").alias("vy"), F.count(F.lit(1)).alias("rows_"))
    row = per.crossJoin(F.broadcast(total)).agg(
        F.max("rows_"), F.count(F.lit(1)), F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2) / F.max(F.col("vy") * F.col("rows_"))).first()
    return int(row[0] or 0), int(row[1]), float(row[2]) if row[2] is not None else float("nan")


def univariate_sweep(df: DataFrame, y: str, predictors: Sequence[str], factors: Sequence[str] = ()) -> DataFrame:
    """One regression per predictor, ranked by R^2: the numeric ones all in one
    aggregation, a factor by its level means (slope and intercept NULL):
    ``(predictor, n, slope, intercept, r2, adj_r2, f_stat, p_value, rank)``."""
    aggs = []
    for i, p in enumerate(predictors):
        aggs += [F.regr_count(F.col(y), F.col(p)).alias(f"n{i}"),
                 F.regr_slope(F.col(y), F.col(p)).alias(f"b{i}"),
                 F.regr_intercept(F.col(y), F.col(p)).alias(f"a{i}"),
                 F.regr_r2(F.col(y), F.col(p)).alias(f"r{i}")]
    row = df.agg(*aggs).collect()[0]
    out = []
    for i, p in enumerate(predictors):
        n, r2 = float(row[f"n{i}"]), row[f"r{i}"]
        r2 = float(r2) if r2 is not None else float("nan")
        dfr = n - 2
        adj = 1 - (1 - r2) * (n - 1) / dfr if dfr > 0 else float("nan")
        f = r2 / (1 - r2) * dfr if r2 < 1 else float("inf")
        out.append((p, int(n), float(row[f"b{i}"]), float(row[f"a{i}"]), r2, adj, f,
                    dists.f_sf(f, 1, dfr)))
    for name in factors:
        n, levels, r2 = factor_fit(df, y, name)
        df1, dfr = levels - 1, n - levels
        usable = df1 > 0 and dfr > 0
        f = (r2 / df1) / ((1 - r2) / dfr) if usable and r2 < 1 else float("inf") if usable else float("nan")
        out.append((name, n, None, None, r2, 1 - (1 - r2) * (n - 1) / dfr if usable else float("nan"), f,
                    dists.f_sf(f, df1, dfr) if usable else float("nan")))
    out.sort(key=lambda r: (r[4] != r[4], -r[4]))
    return df.sparkSession.createDataFrame(
        [(*r, i) for i, r in enumerate(out, 1)], "predictor string, n long, slope double, intercept double, r2 double, adj_r2 double, "
                                                 "f_stat double, p_value double, rank int")


def diagnostics(df: DataFrame, fit: LinearFit, y: str) -> DataFrame:
    """Per-row fitted, residual, standardised residual, sqrt|std resid|,
    leverage and Cook's distance (row expressions, no shuffle)."""
    p = len(fit.terms)
    h = fit.leverage()
    fitted = fit.predict()
    out = df.withColumns({"fitted": fitted, "leverage": h})
    out = out.withColumn("residual", F.col(y) - F.col("fitted"))
    out = out.withColumn("std_resid", F.col("residual") / (F.lit(fit.sigma) * F.sqrt(1 - F.col("leverage"))))
    return out.withColumns({
        "sqrt_abs_std_resid": F.sqrt(F.abs("std_resid")),
        "cooks_d": F.col("std_resid") ** 2 * F.col("leverage") / (p * (1 - F.col("leverage")))})


def qq_points(df: DataFrame, value: str, order_keys: Sequence[str]) -> DataFrame:
    """Normal QQ coordinates: ``theoretical`` = probit of the plotting position
    (i - a) / (n + 1 - 2a), a = 3/8 for n <= 10 else 1/2, for the i-th
    smallest ``value`` (ties broken by ``order_keys``).  The rank is a
    block-parallel running count, not a single-partition window."""
    from panelkit.functions.scalar import probit
    from panelkit.operators.prefix import row_rank, with_range_blocks
    order = [F.col(value), *[F.col(k) for k in order_keys]]
    d = df.where(F.col(value).isNotNull())
    n = d.count()
    d = with_range_blocks(d, order, "_qqblk", n_rows=n)
    ranked = row_rank(d, order, F.col("_qqblk"), "_i").drop("_qqblk")
    a = 0.375 if n <= 10 else 0.5
    pos = (F.col("_i") - F.lit(a)) / F.lit(n + 1 - 2 * a)
    return ranked.withColumn("theoretical", probit(pos)).drop("_i")


def vif(g: Gram, groups: dict[str, Sequence[str]] | None = None) -> list[tuple[str, float, int, float]]:
    """(Generalised) variance inflation factors from the Gram matrix.

    ``groups`` maps a term (e.g. a factor) to its columns; ungrouped columns
    are their own term.  Returns (term, gvif, df, gvif^(1/(2 df))).
    """
    r = g.zz / g.n
    idx = {n: i for i, n in enumerate(g.names)}
    groups = dict(groups or {})
    grouped = {c for cols in groups.values() for c in cols}
    for n in g.names:
        if n not in grouped:
            groups[n] = [n]
    det_all = np.linalg.det(r)
    out = []
    for term, cols in groups.items():
        a = [idx[c] for c in cols]
        b = [i for i in range(g.p) if i not in a]
        d1 = np.linalg.det(r[np.ix_(a, a)])
        d2 = np.linalg.det(r[np.ix_(b, b)]) if b else 1.0
        gv = d1 * d2 / det_all
        out.append((term, float(gv), len(a), float(gv ** (1.0 / (2 * len(a))))))
    return out
