"""Smoothing parameters by Newton's method on GCV, held against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from panelkit.models import gam, gram
from panelkit.models.gram import compute_gram


def basis(x, lo, hi, k):
    """Uniform cubic B-splines by the Cox-de Boor recursion, the first column dropped."""
    h = (hi - lo) / (k - 3)
    t = lo + h * np.arange(-3, k + 1)
    b = [((t[j] <= x) & (x < t[j + 1])).astype(float) for j in range(k + 3)]
    for d in range(1, 4):
        b = [(x - t[j]) / (d * h) * b[j] + (t[j + d + 1] - x) / (d * h) * b[j + 1] for j in range(len(b) - 1)]
    return np.column_stack(b[1:k])


@pytest.fixture(scope="module")
def wavy():
    rng = np.random.default_rng(8)
    n = 1500
    x, w, z = rng.uniform(0, 1, n), rng.uniform(-2, 2, n), rng.integers(0, 2, n)
    y = np.sin(7 * x) + 0.3 * w ** 2 + 0.5 * z + rng.normal(size=n) * 0.4
    return pd.DataFrame({"x": x, "w": w, "z": z.astype(float), "y": y})


@pytest.fixture(scope="module")
def fitted(spark, wavy):
    df = spark.createDataFrame(wavy)
    smooths = gam.smooth_terms(df, ["x", "w"], 10)
    names = ["z", *[nm for s in smooths.values() for nm in s[4]]]
    g = compute_gram(gam.add_basis(df, smooths), names, "y", assume_complete=True)
    return g, smooths


def penalties(g, smooths):
    out = []
    for _c, _lo, _hi, k, names in smooths.values():
        idx = [g.names.index(nm) for nm in names]
        full = np.zeros((len(g.names),) * 2)
        full[np.ix_(idx, idx)] = gam.difference_penalty(k)[1:, 1:] / np.outer(g.scale[idx], g.scale[idx])
        out.append(full)
    return out


def test_derivatives_match_differences(fitted):
    g, smooths = fitted
    pen, rho, h = penalties(g, smooths), np.array([0.7, 2.1]), 1e-4
    _, grad, hess = gam.log_gcv(g, pen, rho)
    for j in range(2):
        e = np.eye(2)[j] * h
        up, down = gam.log_gcv(g, pen, rho + e), gam.log_gcv(g, pen, rho - e)
        assert grad[j] == pytest.approx((up[0] - down[0]) / (2 * h), rel=1e-5, abs=1e-10)
        np.testing.assert_allclose(hess[j], (up[1] - down[1]) / (2 * h), rtol=1e-4, atol=1e-10)


def test_optimum_is_interior_and_not_above_the_grid(fitted):
    g, smooths = fitted
    fit = gam.gam_from_gram(g, smooths, ["z"])
    grid = gam.gam_from_gram(g, smooths, ["z"], lambda_grid=np.logspace(-4, 6, 41))
    assert fit.gcv <= grid.gcv * (1 + 1e-12)
    rho = np.log([fit.lambdas[c] for c in smooths])
    assert (rho > gam.LOG_LAMBDA[0]).all() and (rho < gam.LOG_LAMBDA[1]).all()
    assert np.abs(gam.log_gcv(g, penalties(g, smooths), rho)[1]).max() < 1e-7


def test_edf_and_coefficients_by_plain_numpy(spark, wavy):
    fit = gam.fit_gam(spark.createDataFrame(wavy), "y", ["x", "w"], ["z"], k=10)
    cols = [np.ones(len(wavy)), wavy.z.to_numpy()]
    pen = np.zeros((20, 20))
    for i, c in enumerate(["x", "w"]):
        v = wavy[c].to_numpy()
        cols.append(basis(v, v.min(), v.max() + 1e-12, 10))
        at = slice(2 + 9 * i, 11 + 9 * i)
        pen[at, at] = fit.lambdas[c] * gam.difference_penalty(10)[1:, 1:]
    X = np.column_stack(cols)
    inv = np.linalg.inv(X.T @ X + pen)
    F, y = inv @ X.T @ X, wavy.y.to_numpy()
    beta = inv @ X.T @ y
    assert fit.edf_total == pytest.approx(np.trace(F), rel=1e-6)
    assert [fit.edf["x"], fit.edf["w"]] == pytest.approx([np.trace(F[2:11, 2:11]), np.trace(F[11:, 11:])], rel=1e-5)
    assert fit.intercept == pytest.approx(beta[0], rel=1e-5, abs=1e-6)
    np.testing.assert_allclose(fit.coef, beta[1:], rtol=1e-4, atol=1e-6)
    rss = ((y - X @ beta) ** 2).sum()
    assert fit.gcv == pytest.approx(len(y) * rss / (len(y) - np.trace(F)) ** 2, rel=1e-8)


@pytest.mark.parametrize("seed", range(4))
def test_not_above_the_grid_for_straight_lines(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(0, 1, 400)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 * x + 0.2 * rng.normal(size=400)}))
    smooths = gam.smooth_terms(df, ["x"], 8)
    g = compute_gram(gam.add_basis(df, smooths), list(smooths["x"][4]), "y", assume_complete=True)
    fit, grid = gam.gam_from_gram(g, smooths, []), gam.gam_from_gram(g, smooths, [], lambda_grid=np.logspace(-4, 6, 41))
    assert fit.gcv <= grid.gcv * (1 + 1e-12) and 0.9 < fit.edf["x"] < 8


def test_batches_make_the_design_columns_of_the_expressions(spark):
    """Basis, fitted values and score sums of numpy batches and cell cubics against the column expressions."""
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": rng.uniform(0, 6, 500), "w": rng.integers(0, 9, 500) / 9.0, "z": rng.normal(size=500)})
    pdf["y"] = np.sin(pdf.x) + pdf.w ** 2 + 0.3 * pdf.z
    fit = gam.fit_gam(spark.createDataFrame(pdf).repartition(3), "y", ["x", "w"], ["z"], k=9)
    odd = pd.DataFrame([(-3.0, 0.5, 0.0, 1.0), (9.0, 2.0, 1.0, 1.0), (None, 0.5, 0.0, 1.0), (1.0, 0.5, None, 1.0), (1.0, 0.5, 1.0, None)], columns=["x", "w", "z", "y"])
    df = spark.createDataFrame(pd.concat([pdf, odd]).astype(object).where(lambda d: d.notna(), None), "x double, w double, z double, y double")
    both = fit.design(df).select("x", "w", "z", "y", *fit.names[1:], fit.predict().alias("old"), fit.fitted().alias("new")).toPandas().astype(float)
    np.testing.assert_allclose(both["new"], both["old"], rtol=1e-9, atol=1e-9)
    assert both["new"].isna().sum() == 2
    inside = both.iloc[:500]
    made = gam.design_matrix(fit.smooths)(inside[["x", "w"]].to_numpy())
    np.testing.assert_allclose(made, inside[fit.names[1:]].to_numpy(), atol=1e-10)
    n, total, known, sums = gam.score_sums(spark.createDataFrame(pdf).union(df.where("y is null or z is null")), fit, "y")
    assert (n, known) == (501.0, 500.0) and total == pytest.approx(inside.new.sum() + both.new.iloc[-1])
    left = inside.y - inside.new
    np.testing.assert_allclose(sums[1:], left.to_numpy() @ inside[fit.names].to_numpy(), atol=1e-7)
    np.testing.assert_allclose(sums, [0.0, *fit.penalty_slope().values()], atol=1e-6)


def test_additive_models_send_no_basis_columns(spark, monkeypatch):
    """The basis columns used to be made in the plan, all of them for every row of every pass."""
    seen = []
    real = gram.partition_moments

    def spy(d, cols, *rest):
        seen.append(list(d.columns))
        return real(d, cols, *rest)
    monkeypatch.setattr(gram, "partition_moments", spy)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"x": rng.uniform(size=80), "z": rng.normal(size=80), "y": rng.normal(size=80)}))
    fit = gam.fit_gam(df, "y", ["x"], ["z"], k=10)
    assert seen == [["z", "x", "y"]] and len(fit.names) == 10
