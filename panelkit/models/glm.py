"""Generalised linear models (ML8-ML13).

Poisson-log and binomial-logit models are fitted by ``irls.newton``: each
iteration is one Spark job, the driver solves p x p, and deviance, null deviance
and Pearson chi^2 come from the same passes.  Other links go to MLlib.  Poisson with a log-exposure offset, binomial
(logit), rate/odds ratios with Wald intervals, Pearson dispersion and the
quasi-Poisson rescaling (SE x sqrt(phi), t-based p-values).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.functions import dists
from panelkit.models.batched import spread
from panelkit.models.gram import compute_gram, select_full_rank
from panelkit.models.irls import NewtonFit, newton

INTERCEPT = "(Intercept)"
DEFAULT_LINK = {"poisson": "log", "binomial": "logit"}


@dataclass
class GlmFit:
    terms: list[str]
    estimate: list[float]
    std_error: list[float]
    deviance: float
    null_deviance: float
    df_resid: float
    df_null: float
    aic: float
    family: str
    pearson_chi2: float | None = None
    aliased: list[str] = field(default_factory=list)
    converged: bool = True
    separated: bool = False

    @property
    def dispersion(self) -> float:
        """Pearson chi^2 / residual df (the quasi-Poisson phi)."""
        return self.pearson_chi2 / self.df_resid

    def coef_rows(self, z_mult: float | None = None) -> list[tuple]:
        """(term, estimate, se, z, p, ratio, ci_low, ci_high), ratio = exp(b)."""
        q = z_mult if z_mult is not None else dists.norm_ppf(0.975)
        out = []
        for t, b, s in zip(self.terms, self.estimate, self.std_error):
            z = b / s if s > 0 else float("nan")
            out.append((t, b, s, z, dists.norm_two_sided_p(z), math.exp(b), math.exp(b - q * s),
                        math.exp(b + q * s)))
        return out

    def quasi_rows(self) -> list[tuple]:
        """(term, estimate, se_pois, p_pois, se_quasi, t_quasi, p_quasi)."""
        phi = self.dispersion
        out = []
        for t, b, s in zip(self.terms, self.estimate, self.std_error):
            sq = s * math.sqrt(phi)
            tq = b / sq if sq > 0 else float("nan")
            out.append((t, b, s, dists.norm_two_sided_p(b / s), sq, tq,
                        dists.t_two_sided_p(tq, self.df_resid)))
        return out

    def ratio_table(self, spark: SparkSession, name: str = "rate_ratio", ci: str = "rr") -> DataFrame:
        return spark.createDataFrame(
            self.coef_rows(),
            f"term string, estimate double, std_error double, z_value double, p_value double, "
            f"{name} double, {ci}_ci_low double, {ci}_ci_high double")


def fit_glm(df: DataFrame, y: str, x: Sequence[str], family: str = "poisson", link: str | None = None,
            offset: str | None = None, max_iter: int = 50, pearson: bool = True) -> GlmFit:
    """Fit a GLM; rows with NULL in a used column are dropped.  Predictors that
    are linear combinations of earlier ones (or constant) are left out, as R
    reports them NA, and named in ``aliased``.  ``converged`` is false for a fit
    that stops at ``max_iter`` without settling and for separated classes
    (``separated``: fitted probabilities of 0 or 1)."""
    x = list(x)
    used = x + [y] + ([offset] if offset else [])
    d = df.select(*[F.col(c).cast("double").alias(c) for c in used]).dropna()
    # every IRLS iteration re-reads the design: keep it materialised for the fit
    d = spread(d).persist()
    try:
        gram = compute_gram(d, x, y, assume_complete=True)
        keep = select_full_rank(gram.zz)
        kept = [x[i] for i in keep]
        if link in (None, DEFAULT_LINK.get(family)) and family in DEFAULT_LINK:
            found = newton(d, y, kept, family, gram.mean[keep], gram.scale[keep], offset, max_iter=max_iter)[0]
            fit = from_newton(found, kept, family)
        else:
            fit = _fit(d, y, kept, family, link, offset, max_iter, pearson)
        fit.aliased = [c for c in x if c not in kept]
        return fit
    finally:
        d.unpersist()


def from_newton(found: NewtonFit, x: Sequence[str], family: str) -> GlmFit:
    p = len(x) + 1
    fit = GlmFit([INTERCEPT, *x], [float(b) for b in found.coef], [float(v) ** 0.5 for v in found.cov.diagonal()], found.deviance,
                 found.null_deviance, found.n - p, found.n - 1, -2 * found.loglik + 2 * p, family, found.pearson)
    fit.converged, fit.separated = found.converged, found.separated
    return fit


def _fit(d: DataFrame, y: str, x: list[str], family: str, link: str | None, offset: str | None, max_iter: int,
         pearson: bool) -> GlmFit:
    d = VectorAssembler(inputCols=x, outputCol="_features").transform(d)
    glr = GeneralizedLinearRegression(family=family, link=link or ("log" if family == "poisson" else "logit"),
                                      featuresCol="_features", labelCol=y, maxIter=max_iter, tol=1e-10)
    if offset:
        glr = glr.setOffsetCol(offset)
    m = glr.fit(d)
    s = m.summary
    se = list(s.coefficientStandardErrors)
    est = [float(v) for v in m.coefficients] + [float(m.intercept)]
    terms = x + [INTERCEPT]
    order = [len(x)] + list(range(len(x)))  # intercept first, as R prints it
    fit = GlmFit([terms[i] for i in order], [est[i] for i in order], [float(se[i]) for i in order],
                 float(s.deviance), float(s.nullDeviance), float(s.residualDegreeOfFreedom),
                 float(s.residualDegreeOfFreedomNull), float(s.aic), family)
    fit.converged = int(s.numIterations) < max_iter
    if pearson:
        r = s.residuals("pearson")
        fit.pearson_chi2 = float(r.agg(F.sum(F.col("pearsonResiduals") ** 2)).collect()[0][0])
    return fit


def predict(fit: GlmFit, df: DataFrame, x: Sequence[str], out: str = "prediction") -> DataFrame:
    """Batch scoring: mean response as a row expression (inverse link)."""
    eta = F.lit(fit.estimate[0])
    for t, b in zip(fit.terms[1:], fit.estimate[1:]):
        eta = eta + F.lit(b) * F.col(t)
    mu = F.exp(eta) if fit.family == "poisson" else 1 / (1 + F.exp(-eta))
    return df.withColumn(out, mu)


def dispersion_row(fit: GlmFit, threshold: float) -> dict:
    return {"deviance": fit.deviance, "df_residual": fit.df_resid,
            "deviance_ratio": fit.deviance / fit.df_resid, "pearson_chi2": fit.pearson_chi2,
            "pearson_ratio": fit.dispersion,
            "overdispersed": int(fit.deviance / fit.df_resid > threshold)}
