"""Model operators against brute force and the reference's published arithmetic."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.functions import dists
from panelkit.models import classify as C, evaluate as EV, gam, glm, ols
from panelkit.models.gram import compute_gram


def test_dists_known_values():
    assert dists.t_ppf(0.975, 10) == pytest.approx(2.228138851986, rel=1e-9)
    assert dists.t_two_sided_p(2.228138851986, 10) == pytest.approx(0.05, rel=1e-8)
    assert dists.norm_ppf(0.975) == pytest.approx(1.959963984540, rel=1e-12)
    assert dists.f_sf(4.964602743730712, 1, 10) == pytest.approx(0.05, rel=1e-8)
    assert dists.t_ppf(0.975, 1e9) == pytest.approx(1.959963984540, rel=1e-6)


def test_ols_matches_numpy_and_aliasing(spark):
    rng = np.random.default_rng(0)
    n = 2000
    x1, x2 = rng.normal(size=n) * 1000 + 5e4, rng.normal(size=n)
    y = 3 + 0.002 * x1 - 1.5 * x2 + rng.normal(size=n)
    pdf = pd.DataFrame({"x1": x1, "x2": x2, "x3": 2 * x2, "y": y})
    fit = ols.fit_ols(spark.createDataFrame(pdf), "y", ["x1", "x2", "x3"])
    X = np.column_stack([np.ones(n), x1, x2])
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    assert fit.aliased == ["x3"]
    np.testing.assert_allclose(fit.coef, beta, rtol=1e-8)
    resid = y - X @ beta
    s2 = resid @ resid / (n - 3)
    np.testing.assert_allclose(fit.se(), np.sqrt(np.diag(s2 * np.linalg.inv(X.T @ X))), rtol=1e-6)
    assert fit.r2 == pytest.approx(1 - resid @ resid / ((y - y.mean()) @ (y - y.mean())), rel=1e-9)
    rows = fit.coef_rows()
    assert rows[1][5] < beta[1] < rows[1][6]


def test_vif_two_predictors(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=1000)
    b = 0.6 * a + rng.normal(size=1000)
    g = compute_gram(spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "y": a + b})), ["a", "b"], "y")
    r = np.corrcoef(a, b)[0, 1]
    for _t, gv, df, _adj in ols.vif(g):
        assert gv == pytest.approx(1 / (1 - r * r), rel=1e-9) and df == 1


def test_poisson_offset_closed_form_and_quasi(spark):
    rng = np.random.default_rng(2)
    n = 600
    g = rng.integers(0, 2, n)
    e = rng.integers(5, 31, n).astype(float)
    y = rng.poisson(e * np.where(g == 1, 0.4, 0.1) * rng.gamma(2, 0.5, n))
    pdf = pd.DataFrame({"y": y.astype(float), "g": g.astype(float), "off": np.log(e)})
    fit = glm.fit_glm(spark.createDataFrame(pdf), "y", ["g"], "poisson", offset="off")
    r1 = y[g == 1].sum() / e[g == 1].sum()
    r0 = y[g == 0].sum() / e[g == 0].sum()
    assert fit.estimate[1] == pytest.approx(math.log(r1 / r0), rel=1e-8)
    assert fit.std_error[1] == pytest.approx(math.sqrt(1 / y[g == 1].sum() + 1 / y[g == 0].sum()), rel=1e-6)
    phi = fit.dispersion
    for _t, _b, s, _p, sq, _tq, _pq in fit.quasi_rows():
        assert sq / s == pytest.approx(math.sqrt(phi))
    assert glm.dispersion_row(fit, 1.5)["overdispersed"] == int(fit.deviance / fit.df_resid > 1.5)


def test_published_reference_arithmetic(spark):
    # fixed values: published confusion counts with their metrics, and a published deviance with its rate ratio
    tp, tn, fp, fn = 8011, 7357, 2627, 1971
    counts = spark.createDataFrame([(1, 1, tp), (0, 0, tn), (0, 1, fp), (1, 0, fn)], "label int, pred int, n int")
    m = EV.class_metrics(counts.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))), "label", "pred").first()
    assert m["accuracy"] == pytest.approx(0.7697, abs=5e-5)
    assert m["sensitivity"] == pytest.approx(0.8025, abs=5e-5)
    assert m["specificity"] == pytest.approx(0.7369, abs=5e-5)
    fit = glm.GlmFit(["x"], [1.532964], [0.1], 27529.614, 0.0, 3291.0, 3292.0, 0.0, "poisson", pearson_chi2=27529.614)
    assert fit.ratio_table(spark).first()["rate_ratio"] == pytest.approx(4.6319, abs=5e-5)
    assert fit.quasi_rows()[0][4] == pytest.approx(0.1 * math.sqrt(8.3651), rel=1e-4)
    assert glm.dispersion_row(fit, 1.5)["deviance_ratio"] == pytest.approx(8.3651, abs=5e-5)


def test_svm_cost_is_on_the_kernel_features(spark):
    """Squared norm and objective against a small exact solution of the same problem."""
    rng = np.random.default_rng(11)
    p = rng.normal(size=(300, 2))
    lab = (p[:, 0] + 0.5 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": p[:, 0], "b": p[:, 1], "label": lab}))
    m = C.fit_svm(df, ["a", "b"], "label", gamma=0.5, cost=0.1, n_features=16, max_iter=500, tol=1e-10)
    z = C.rff_frame(df, ["a", "b"], 0.5, 16).select("features").toPandas()["features"].map(lambda v: v.toArray())
    z, s = np.stack(z.to_list()), 2.0 * lab - 1

    def objective(w, b):
        return 0.5 * w @ w + 0.1 * np.maximum(0, 1 - s * (z @ w + b)).sum()

    w, b, best = np.zeros(16), 0.0, np.inf
    for t in range(1, 30_000):                   # subgradient descent on the exact objective
        miss = s * (z @ w + b) < 1
        g, gb = w - 0.1 * (s[miss] @ z[miss]), -0.1 * s[miss].sum()
        w, b = w - g / (1 + t / 50), b - gb / (10 + t)
        best = min(best, objective(w, b))
    assert objective(m.coefficients.toArray(), m.intercept) == pytest.approx(best, rel=0.02)


def test_scores_keep_incomplete_rows(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 1), (None, 1), (0.1, 0), (0.9, 1)], "a double, label int")
    m = C.fit_mlp(df, ["a"], "label", hidden=2, max_iter=20)
    out = C.score_mlp(m, df, ["a"])
    assert out.count() == 5 and out.where("a is null").first()["prob"] is None and out.where("prob is null").count() == 1


def test_auc_and_r2_use_scored_rows_only(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.1), (0, None), (1, None), (None, 0.5)], "label int, score double")
    row = EV.auc(df, "label", "score").first()
    assert row["auc"] == 1.0 and EV.unscored(df, "label", "score").first()["n_unscored"] == 3
    m = EV.reg_metrics(spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5), (9.0, None)], "y double, p double"), "y", "p").first()
    assert m["n"] == 3 and m["r2"] == pytest.approx(0.75)


def test_aliased_glm_names_its_term(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=400)
    pdf = pd.DataFrame({"x": x, "x2": 3 * x, "one": np.ones(400), "y": rng.poisson(np.exp(0.3 * x)).astype(float)})
    fit = glm.fit_glm(spark.createDataFrame(pdf), "y", ["x", "x2", "one"], "poisson")
    assert fit.aliased == ["x2", "one"] and fit.converged and len(fit.terms) == 2


def test_partials_to_the_driver_do_not_grow_with_partitions(spark):
    from panelkit.models import gram
    pdf = pd.DataFrame(np.random.default_rng(13).normal(size=(600, 10)), columns=[f"c{i}" for i in range(10)])
    df = spark.createDataFrame(pdf)
    n, mean, m2 = gram.partition_moments(df.repartition(300), list(pdf.columns))
    assert n == 600
    np.testing.assert_allclose(mean, pdf.mean().to_numpy(), atol=1e-12)
    np.testing.assert_allclose(m2, (pdf - pdf.mean()).T @ (pdf - pdf.mean()), rtol=1e-9, atol=1e-9)


def test_smooth_goes_on_linearly_outside_the_data(spark):
    x = np.linspace(0, 5, 200)
    fit = gam.fit_gam(spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 * x})), "y", ["x"], k=8)
    far = spark.createDataFrame([(-3.0,), (2.5,), (10.0,)], "x double")
    got = [r["f"] for r in fit.design(far).select("x", fit.predict().alias("f")).orderBy("x").collect()]
    assert got == pytest.approx([-6.0, 5.0, 20.0], abs=0.05)


def test_own_models_are_saved_and_reused(spark, tmp_path):
    from panelkit.models import logistic_net as LN
    from panelkit.sources import io
    rng = np.random.default_rng(14)
    pdf = pd.DataFrame({"x": rng.normal(size=200), "z": rng.normal(size=200)})
    df = spark.createDataFrame(pdf.assign(y=pdf.x + 1, c=(pdf.x > 0).astype(float)))
    fits = {"ols": lambda: ols.fit_ols(df, "y", ["x", "z"]), "gam": lambda: gam.fit_gam(df, "y", ["x"], ["z"], k=6),
            "glm": lambda: glm.fit_glm(df, "c", ["z"], "binomial"), "net": lambda: LN.fit_logistic_net(df, ["x"], "c", hidden=2, max_iter=3)}
    for name, make in fits.items():
        calls = []
        path = str(tmp_path / name)
        first = io.fit_or_load(path, lambda: (calls.append(1), make())[1])
        again = io.fit_or_load(path, lambda: (calls.append(1), make())[1])
        assert len(calls) == 1 and type(again) is type(first)
        for k, v in vars(first).items():
            np.testing.assert_equal(getattr(again, k), v)
    (tmp_path / "bad").mkdir()
    with pytest.raises(Exception):
        io.fit_or_load(str(tmp_path / "bad"), lambda: 1 / 0)


def test_class_metrics_and_auc_rank_formula(spark):
    rng = np.random.default_rng(5)
    n = 3000
    label = rng.integers(0, 2, n)
    score = np.round(label * 0.3 + rng.normal(size=n), 1)  # many ties
    pdf = pd.DataFrame({"label": label, "score": score, "pred": (score > 0.15).astype(int)})
    df = spark.createDataFrame(pdf)
    a = EV.auc(df, "label", "score").collect()[0]["auc"]
    ranks = pd.Series(score).rank().to_numpy()
    n1, n0 = label.sum(), n - label.sum()
    mw = (ranks[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)
    assert a == pytest.approx(mw, rel=1e-12)
    # invariant under a monotone score map and row order
    a2 = EV.auc(df.withColumn("score", F.exp("score")).orderBy(F.rand(1)), "label", "score").collect()[0]["auc"]
    assert a2 == pytest.approx(a, rel=1e-12)
    m = EV.class_metrics(df, "label", "pred").collect()[0]
    assert m["accuracy"] == pytest.approx(((pdf.pred == pdf.label).mean()))


def test_pspline_recovers_sine_and_linear_limit(spark):
    rng = np.random.default_rng(6)
    x = rng.uniform(0, 2 * np.pi, 3000)
    y = np.sin(x) + rng.normal(0, 0.3, x.size)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    fit = gam.fit_gam(df, "y", ["x"], k=10)
    pred = gam.add_basis(spark.createDataFrame(pd.DataFrame({"x": np.linspace(0.2, 6, 30)})), fit.smooths) \
        .select("x", fit.predict().alias("f")).toPandas()
    assert np.max(np.abs(pred.f - np.sin(pred.x))) < 0.15
    assert 3 < fit.edf["x"] < 9
    lin = gam.fit_gam(df.withColumn("y", F.col("x") * 2 + 1), "y", ["x"], k=10, lambdas={"x": 1e9})
    assert lin.edf["x"] == pytest.approx(1.0, abs=1e-3)  # lambda -> inf: straight line


def test_rff_svm_learns_ring(spark):
    rng = np.random.default_rng(7)
    p = rng.uniform(-1, 1, size=(2000, 2))
    lab = ((p ** 2).sum(axis=1) < 0.45).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"a": p[:, 0], "b": p[:, 1], "label": lab}))
    m = C.fit_svm(df, ["a", "b"], "label", gamma=2.0, cost=10.0, n_features=128, max_iter=200)
    s = C.score_svm(m, df, ["a", "b"], gamma=2.0, n_features=128)
    acc = s.select(F.avg((F.col("pred") == F.col("label")).cast("double"))).collect()[0][0]
    assert acc > 0.9


def test_probit_matches_normal_quantile(spark):
    from statistics import NormalDist

    from panelkit.functions.scalar import probit
    ps = [1e-6, 0.001, 0.02425, 0.03, 0.1, 0.3, 0.5, 0.77, 0.975, 0.999, 1 - 1e-7]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", probit("p").alias("z")).collect()
    for r in got:
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=2e-8, abs=1e-9)


def test_coefficients_and_mllib_model_roundtrip(spark, tmp_path):
    from pyspark.ml.classification import MultilayerPerceptronClassificationModel

    from panelkit.sources import io
    io.save_coefficients(spark, str(tmp_path / "coef"), ["(Intercept)", "x"], [1.0, 2.0], [[1, 0], [0, 1]])
    back = io.load_coefficients(spark, str(tmp_path / "coef"))
    assert back["terms"] == ["(Intercept)", "x"] and back["coef"] == [1.0, 2.0]
    df = spark.createDataFrame(pd.DataFrame({"a": [0.0, 1.0, 0.0, 1.0] * 10, "label": [0, 1, 0, 1] * 10}))
    path = str(tmp_path / "mlp")
    calls = []

    def fit():
        calls.append(1)
        return C.fit_mlp(df, ["a"], "label", hidden=2, max_iter=20)
    m1 = io.fit_or_load(path, fit, MultilayerPerceptronClassificationModel.load)
    m2 = io.fit_or_load(path, fit, MultilayerPerceptronClassificationModel.load)
    assert len(calls) == 1 and m2.layers == m1.layers


def test_logistic_net_gradient_and_fit(spark):
    from panelkit.models import logistic_net as LN
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 2))
    y = ((x[:, 0] * x[:, 1]) > 0).astype(float)  # XOR-like: needs the hidden layer
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": y}))
    ev = LN._objective_job(df, ["a", "b"], "y", 3)
    th = rng.normal(size=LN.n_weights(2, 3))
    loss, g = ev(th)
    eps = 1e-6
    for i in (0, 4, 7, 12):
        e = np.zeros_like(th)
        e[i] = eps
        num = (ev(th + e)[0] - ev(th - e)[0]) / (2 * eps)
        assert num == pytest.approx(g[i], rel=1e-4, abs=1e-4)
    net = LN.fit_logistic_net(df, ["a", "b"], "y", hidden=4, decay=0.001, max_iter=150, seed=1)
    acc = LN.score(net, df).select(F.avg((F.col("pred") == F.col("y")).cast("double"))).collect()[0][0]
    assert acc > 0.85
