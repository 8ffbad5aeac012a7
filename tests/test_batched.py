"""Fits that share their passes: against the same fits one by one and against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelkit.models import batched, classify as C, folds, glm, irls, kernel_svm as KS, logistic_net as LN, ols
from panelkit.models.gram import compute_gram


def ring(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-2, 2, size=(n, 2))
    r = np.hypot(x[:, 0], x[:, 1])
    y = (r < 1.4).astype(int)
    return pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": y, "fold": np.arange(n) % 5})


def test_grid_search_over_five_folds(spark):
    pdf = ring(1500, 1)
    df = spark.createDataFrame(pdf).repartition(3)
    found = KS.grid_search(df, ["a", "b"], "label", "fold", [0.01, 1.0], [1.0, 10.0], m=60, max_iter=60)
    assert [(g, c) for g, c, *_ in found.rows] == [(0.01, 1.0), (0.01, 10.0), (1.0, 1.0), (1.0, 10.0)]
    assert all(n == 1500 for *_, n in found.rows)
    errors = {(g, c): e for g, c, e, _ in found.rows}
    assert found.best.gamma == 1.0 and errors[1.0, 10.0] < 0.05 < errors[0.01, 1.0]
    # the same candidate trained alone, with its fold really taken out, errs as often
    alone = []
    for k in range(5):
        kernel = found.best.kernel
        data = KS.training_rows(df.where(F.col("fold") != k), ["a", "b"], "label", None)
        runs, _, _ = KS.train_together(data, 2, kernel, [KS.Setting(1.0, 10.0, None)], 60, 1e-4)
        test = pdf[pdf.fold == k]
        z = kernel.features(kernel.distances(test[["a", "b"]].to_numpy()), 1.0)
        alone.append(np.mean((z @ runs[0].theta >= 0) != (test.label == 1)))
    assert np.mean(alone) == pytest.approx(errors[1.0, 10.0], abs=0.01)
    scored = found.best.score(df.union(spark.createDataFrame([(None, 1.0, 1, 0)], df.schema)))
    assert scored.filter("pred is null").count() == 1
    assert scored.select(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0] > 0.95


def test_both_kernel_maps_against_an_exact_kernel_fit(spark):
    """Held-out error on a ring: exact RBF kernel machine (kernel ridge on signs,
    driver-sized), Nystroem landmarks, random Fourier features."""
    train, test = ring(600, 2), ring(800, 3)
    x, y, t = train[["a", "b"]].to_numpy(), 2.0 * train.label - 1, test[["a", "b"]].to_numpy()

    def kernel(p, q):
        return np.exp(-1.0 * ((p[:, None, :] - q[None, :, :]) ** 2).sum(-1))
    exact = np.mean((kernel(t, x) @ np.linalg.solve(kernel(x, x) + 0.1 * np.eye(len(x)), y) >= 0) != (test.label == 1))
    df, held = spark.createDataFrame(train), spark.createDataFrame(test)
    machine = KS.fit(df, ["a", "b"], "label", gamma=1.0, cost=10.0, m=64)
    nystroem = machine.score(held).select(F.avg((F.col("pred") != F.col("label")).cast("double"))).first()[0]
    rff = C.fit_svm(df, ["a", "b"], "label", gamma=1.0, cost=10.0, n_features=64, max_iter=60)
    fourier = C.score_svm(rff, held, ["a", "b"], gamma=1.0, n_features=64).select(F.avg((F.col("pred") != F.col("label")).cast("double"))).first()[0]
    print(f"held-out error: exact {exact:.4f}, Nystroem {nystroem:.4f}, Fourier {fourier:.4f}")
    assert exact < 0.06 and nystroem <= exact + 0.02 and fourier < 0.15


def test_landmarks_do_not_depend_on_partitions_and_follow_weights(spark):
    df = spark.createDataFrame(ring(400, 4)).withColumn("w", F.when(F.col("a") > 0, 50.0).otherwise(0.02))
    a, b = KS.landmarks(df, ["a", "b"], 30, "w"), KS.landmarks(df.repartition(7).union(df.limit(0)), ["a", "b"], 30, "w")
    assert np.array_equal(a, b) and (a[:, 0] > 0).mean() > 0.9
    assert len(KS.landmarks(df.union(df), ["a", "b"], 1000)) == 400          # repeated rows are one landmark


def test_training_grams_equal_grams_of_the_subsets(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(700, 4)) * [1, 1e4, 1e-3, 1] + [0, 1e6, 5, 0], columns=["p", "q", "r", "y"])
    pdf["fold"] = rng.integers(0, 4, 700).astype(float)
    df = spark.createDataFrame(pdf).repartition(5)
    for k, g in enumerate(folds.training_grams(df, ["p", "q", "r"], "y", "fold", 4)):
        want = compute_gram(df.where(F.col("fold") != k), ["p", "q", "r"], "y")
        assert g.n == want.n
        np.testing.assert_allclose(g.mean, want.mean, rtol=1e-10)
        np.testing.assert_allclose(g.zz, want.zz, rtol=1e-7, atol=1e-7)
        np.testing.assert_allclose(ols.ols_from_gram(g).coef, ols.ols_from_gram(want).coef, rtol=1e-6)
        sub = folds.sub_gram(g, ["r", "p"])
        assert sub.names == ["r", "p"] and sub.zz[0, 1] == g.zz[2, 0]


@pytest.mark.parametrize("family", ["poisson", "binomial"])
def test_newton_equals_mllib(spark, family):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 2)) * [1, 40] + [0, 300]
    eta = 0.2 + 0.5 * x[:, 0] - 0.01 * (x[:, 1] - 300)
    off = rng.uniform(0, 1, 800)
    y = rng.poisson(np.exp(eta + off)) if family == "poisson" else rng.random(800) < 1 / (1 + np.exp(-eta))
    df = spark.createDataFrame(pd.DataFrame({"u": x[:, 0], "v": x[:, 1], "off": off, "y": y.astype(float)}))
    offset = "off" if family == "poisson" else None
    own = glm.fit_glm(df, "y", ["u", "v"], family, offset=offset)
    ml = glm._fit(df, "y", ["u", "v"], family, None, offset, 50, True)
    assert own.terms == ml.terms and own.converged and not own.separated
    for name in ("estimate", "std_error"):
        np.testing.assert_allclose(getattr(own, name), getattr(ml, name), rtol=1e-6)
    for name in ("deviance", "null_deviance", "aic", "pearson_chi2", "df_resid", "df_null"):
        assert getattr(own, name) == pytest.approx(getattr(ml, name), rel=1e-7), name


def test_newton_over_folds_and_separated_classes(spark):
    pdf = ring(900, 7)
    pdf["y"] = (pdf.a + np.random.default_rng(1).normal(size=900) > 0).astype(float)
    df = spark.createDataFrame(pdf).repartition(4)
    fits = irls.newton(df, "y", ["a", "b"], "binomial", np.zeros(2), np.ones(2), fold="fold", leave_out=[0, 3, None])
    for k, fit in zip((0, 3, None), fits):
        part = df.where(F.col("fold") != k) if k is not None else df
        want = glm.fit_glm(part, "y", ["a", "b"], "binomial")
        np.testing.assert_allclose(fit.coef, want.estimate, rtol=1e-6)
        assert fit.n == part.count()
    apart = spark.createDataFrame(pd.DataFrame({"x": np.arange(40.0), "y": (np.arange(40) >= 20).astype(float)}))
    fit = glm.fit_glm(apart, "y", ["x"], "binomial")
    assert fit.separated and not fit.converged


def test_networks_of_all_folds_train_together(spark):
    pdf = ring(1000, 8)
    df = spark.createDataFrame(pdf.astype(float)).repartition(3).cache()
    runs = LN.fit_fold_nets(df, ["a", "b"], "label", "fold", 5, hidden=4, max_iter=120)
    errors = LN.held_out_net_errors(df, ["a", "b"], "label", "fold", 4, [r.theta for r in runs])
    assert len(errors) == 5 and np.mean(errors) < 0.12
    # value and gradient over a training set are those of the rows alone
    theta = runs[0].theta
    loss, grad = LN._evaluate(df, ["a", "b"], "label", 4, np.array([theta, theta]), "fold", np.array([2, 4]))
    for i, k in enumerate((2, 4)):
        want, g = LN._objective_job(df.where(F.col("fold") != k), ["a", "b"], "label", 4)(theta)
        assert loss[i] == pytest.approx(want) and grad[i] == pytest.approx(g, abs=1e-8)


def test_descent_finds_minima_and_counts_evaluations():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(12, 12))
    h = a @ a.T + np.diag(np.logspace(-2, 2, 12))
    runs = [batched.Descent(rng.normal(size=12), 200, 1e-14) for _ in range(3)]
    jobs = batched.descend(runs, lambda which: (np.array([0.5 * runs[i].trial @ h @ runs[i].trial for i in which]), [h @ runs[i].trial for i in which]))
    assert all(r.value < 1e-6 for r in runs) and jobs < 300


def test_sums_over_many_partitions_reach_the_driver_as_a_few(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x")).repartition(90)
    out = batched.sum_over_rows(df, ["x"], lambda b: np.array([len(b), b.sum()]), 2)
    assert out.tolist() == [1000.0, 499500.0]
    assert batched.sum_over_rows(df.limit(0), ["x"], lambda b: np.array([1.0]), 1).tolist() == [0.0]


def test_points_tried_ahead_change_no_step():
    rng = np.random.default_rng(3)
    scale = np.logspace(0, 4, 6)

    def value(x):
        return float((scale * np.abs(x) ** 1.5).sum()), scale * 1.5 * np.sign(x) * np.abs(x) ** 0.5
    start = [rng.normal(size=6) for _ in range(4)]
    plain, ahead = ([batched.Descent(x, 60, 1e-6) for x in start] for _ in range(2))
    alone = batched.descend(plain, lambda which: tuple(zip(*[value(plain[i].trial) for i in which])))
    seen = []

    def along(which, steps):
        seen.append(max(map(len, steps)))
        return [[value(ahead[i].theta + s * ahead[i].direction) for s in tried] for i, tried in zip(which, steps)]
    together = batched.descend_ahead(ahead, along, spare=2)
    for p, q in zip(plain, ahead):
        assert p.iterations == q.iterations and p.value == q.value and np.array_equal(p.theta, q.theta)
    assert together < 0.7 * alone and 1 < max(seen) <= batched.MAX_AHEAD


def test_blocks_hold_every_row_once_and_one_fold_each(spark):
    pdf = pd.DataFrame({"x": np.arange(3000.0), "fold": np.arange(3000) % 7.0, "z": 1.0})
    data = batched.in_blocks(spark.createDataFrame(pdf), ["x", "fold", "z"], by="fold")
    try:
        assert data.counts("fold") == {float(k): int((pdf.fold == k).sum()) for k in range(7)}
        out = batched.sum_over_rows(data, ["fold", "x"], lambda b: np.array([len(b), b[:, 1].sum(), len(np.unique(b[:, 0])) > 1, len(b) > batched.BLOCK_ROWS]), 4)
        assert out.tolist() == [3000.0, float(pdf.x.sum()), 0.0, 0.0]
    finally:
        data.unpersist()
    empty = batched.in_blocks(spark.createDataFrame(pdf).limit(0), ["x"])
    assert batched.sum_over_rows(empty, ["x"], lambda b: np.ones(1), 1).tolist() == [0.0] and empty.counts("x") == {}


def test_blocks_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(batched, "PARTITION_ROWS", 100)
    data = batched.in_blocks(spark.range(0, 2000, 1, 2).select(F.col("id").cast("double").alias("x")), ["x"])
    assert data.partitions == data.frame.rdd.getNumPartitions() == 20
    rows = data.frame.select(F.sum(F.length("block") / 8)).first()[0]
    assert rows == 2000
    data.unpersist()


def test_a_search_takes_as_few_passes_as_steps(spark):
    """Refused steps used to cost a pass each (several a step on this loss)."""
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"a": rng.normal(size=900), "b": rng.normal(size=900), "label": rng.integers(0, 2, 900), "fold": np.arange(900) % 3})
    df = spark.createDataFrame(pdf)
    kernel = KS.kernel_map(KS.landmarks(df, ["a", "b"], 20), [0.1])
    data = KS.training_rows(df, ["a", "b"], "label", "fold")
    settings = [KS.Setting(0.1, c, k) for c in (1.0, 100.0) for k in (0, 1, 2, None)]
    runs, passes, errors = KS.train_together(data, 2, kernel, settings, 60, 1e-4)
    assert passes <= 2 * max(r.iterations for r in runs) + 4
    # value and gradient are those of plain features over the rows outside the fold
    x, y, fold = pdf[["a", "b"]].to_numpy(), 2.0 * pdf.label.to_numpy() - 1, pdf.fold.to_numpy()
    z = kernel.features(kernel.distances(x), 0.1)
    for s, r, (wrong, held) in zip(settings, runs, errors):
        inside = fold != (-1 if s.fold is None else s.fold)
        short = np.maximum(1 - y * (z @ r.theta), 0)[inside]
        loss = np.where(short < KS.SMOOTH, short ** 2 / (2 * KS.SMOOTH), short - KS.SMOOTH / 2)
        slope = -np.minimum(short / KS.SMOOTH, 1) * y[inside]
        pull = np.append(r.theta[:-1], 0) / (s.cost * inside.sum())
        assert r.value == pytest.approx(loss.mean() + 0.5 * float(pull @ r.theta), rel=1e-9)
        np.testing.assert_allclose(r.grad, z[inside].T @ slope / inside.sum() + pull, rtol=1e-6, atol=1e-9)
        assert (wrong, held) == ((((z @ r.theta >= 0) != (y > 0)) & ~inside).sum(), (~inside).sum())
    data.unpersist()


def test_blocks_with_a_design_serve_the_folds_like_its_columns(spark):
    """Cross-products, moments, Newton fits, networks and held-out errors of blocks against those of a table."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame(rng.normal(size=(900, 2)) * [1, 30] + [0, 500], columns=["u", "v"])
    pdf["y"] = (pdf.u + rng.normal(size=900) > 0).astype(float)
    pdf["fold"] = rng.integers(0, 4, 900).astype(float)
    table = spark.createDataFrame(pdf.assign(uu=pdf.u ** 2)).repartition(3).cache()
    data = batched.in_blocks(spark.createDataFrame(pdf).repartition(5), ["u", "v", "y", "fold"], by="fold")
    design = folds.Design(["u", "v"], ["u", "v", "uu"], lambda b: np.column_stack([b, b[:, 0] ** 2]))
    mean, scale = folds.block_moments(data, design)
    np.testing.assert_allclose(mean, [pdf.u.mean(), pdf.v.mean(), (pdf.u ** 2).mean()], rtol=1e-10)
    np.testing.assert_allclose(scale, [pdf.u.std(ddof=0), pdf.v.std(ddof=0), (pdf.u ** 2).std(ddof=0)], rtol=1e-10)
    for a, b in zip(folds.training_grams(data, design, "y", "fold", 4), folds.training_grams(table, ["u", "v", "uu"], "y", "fold", 4)):
        assert a.names == b.names and a.n == b.n
        np.testing.assert_allclose(a.zz, b.zz, rtol=1e-9, atol=1e-8)
        np.testing.assert_allclose(a.zy, b.zy, rtol=1e-9, atol=1e-8)
    coef = rng.normal(size=(4, 4))
    models = {"m": (coef, 0.5)}
    assert folds.held_out_errors(data, design, "y", "fold", 4, models) == folds.held_out_errors(table, ["u", "v", "uu"], "y", "fold", 4, models)
    fits = [irls.newton(d, "y", ["u", "v"], "binomial", mean[:2], scale[:2], fold="fold", leave_out=range(4)) for d in (data, table)]
    for a, b in zip(*fits):
        np.testing.assert_allclose(a.coef, b.coef, rtol=1e-8)
        assert a.n == b.n
    points = rng.normal(size=(3, LN.n_weights(2, 3))) * 0.1
    sides = [LN._evaluate(d, ["u", "v"], "y", 3, points, "fold", np.array([0, 2, 3])) for d in (data, table)]
    np.testing.assert_allclose(sides[0][0], sides[1][0], rtol=1e-10)
    np.testing.assert_allclose(sides[0][1], sides[1][1], rtol=1e-8, atol=1e-8)
    data.unpersist()


def test_kernel_features_are_dealt_by_their_size(spark, monkeypatch):
    """A fit used to keep as many partitions as its input came in, however large their features."""
    dealt = []
    real = C.LinearSVC.fit
    monkeypatch.setattr(C.LinearSVC, "fit", lambda self, d: (dealt.append(d.rdd.getNumPartitions()), real(self, d))[1])
    pdf = ring(1000, 12)
    df = spark.createDataFrame(pdf).coalesce(1)
    plain = C.fit_svm(df, ["a", "b"], "label", gamma=1.0, cost=1.0, n_features=8, max_iter=20)
    monkeypatch.setattr(C, "FEATURE_BYTES", 100 * 8 * 8)
    small = C.fit_svm(df, ["a", "b"], "label", gamma=1.0, cost=1.0, n_features=8, max_iter=20)
    assert dealt == [1, 10]
    np.testing.assert_allclose(plain.coefficients.toArray(), small.coefficients.toArray(), rtol=1e-3, atol=1e-3)


def test_blocks_are_kept_small_and_on_disk(spark):
    """They used to be kept at their full size, in memory first."""
    flags = [(F.col("id") % k == 0).cast("double").alias(f"d{k}") for k in (2, 3, 5, 7)]
    data = batched.in_blocks(spark.range(0, 20_000, 1, 2).select(*flags, (F.col("id") % 5).cast("double").alias("fold")), ["d2", "d3", "d5", "d7", "fold"], by="fold")
    try:
        kept, full = data.packed.select(F.sum(F.length("packed")), F.sum("size")).first()
        assert full == 20_000 * 5 * 8 and kept < full / 4
        level = data.packed.storageLevel
        assert level.useDisk and not level.useMemory
        assert batched.sum_over_rows(data, ["d3", "fold"], lambda b: b.sum(0), 2).tolist() == [6667.0, 40_000.0]
    finally:
        data.unpersist()


@pytest.mark.parametrize("gamma, cost, tol", [(1.0, 1.0, 1e-4), (0.1, 10.0, 1e-6)])
def test_svm_without_kept_features_is_the_same_machine(spark, monkeypatch, gamma, cost, tol):
    """A fit used to keep all kernel features, however many."""
    pdf = ring(1500, 13)
    pdf.loc[7:9, "a"] = [np.nan, np.inf, -np.inf]
    df = spark.createDataFrame(pdf).repartition(3).persist()
    kept = C.fit_svm(df, ["a", "b"], "label", gamma=gamma, cost=cost, n_features=16, max_iter=40, tol=tol)
    monkeypatch.setattr(C, "KEPT_BYTES", 0)
    monkeypatch.setattr(C.LinearSVC, "fit", lambda *_: pytest.fail("the features are kept"))
    passes = C.fit_svm(df, ["a", "b"], "label", gamma=gamma, cost=cost, n_features=16, max_iter=40, tol=tol)
    np.testing.assert_allclose(passes.coefficients.toArray(), kept.coefficients.toArray(), rtol=1e-6, atol=1e-8)
    assert passes.intercept == pytest.approx(kept.intercept, rel=1e-6)
    scored = df.where(F.abs("a") < 3)
    said = [C.score_svm(m, scored, ["a", "b"], gamma=gamma, n_features=16).groupBy("pred").count().collect() for m in (kept, passes)]
    assert sorted(map(str, said[0])) == sorted(map(str, said[1]))
    df.unpersist()
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        C.fit_svm(df.withColumn("label", F.lit(None).cast("int")), ["a", "b"], "label", gamma=1.0, cost=1.0, n_features=4, max_iter=2)
