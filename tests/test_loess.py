"""LOESS by nearest-neighbour span, against the whole operator matrix."""

import numpy as np
import pandas as pd
import pytest

from panelkit.models import loess


def operator(x, at, span, degree=2):
    """Rows of L for every evaluation point, by weighted least squares."""
    q = int(np.floor(len(x) * span + 1e-5))
    out = np.zeros((len(at), len(x)))
    for i, g in enumerate(at):
        d = np.abs(x - g)
        h = np.sort(d)[min(q, len(x)) - 1] * max(1.0, span)
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        b = np.vander((x - g) / h, degree + 1, increasing=True)
        out[i] = np.linalg.solve(b.T @ (b * w[:, None]), (b * w[:, None]).T)[0]
    return out


@pytest.mark.parametrize("span,degree", [(0.3, 2), (0.5, 1), (1.5, 2)])
def test_fit_and_error_on_200_rows(spark, span, degree):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=200), 2)                # repeated values among them
    y = np.sin(2 * x) + rng.normal(0, 0.2, 200)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).union(spark.createDataFrame([(None, 1.0), (float("nan"), 2.0), (0.1, None)], "x double, y double"))
    points = np.unique(x)
    got = loess.loess_span(df.repartition(4), "x", "y", span=span, degree=degree, points=points.tolist()).toPandas().sort_values("grid_idx")
    rows, data = operator(x, points, span, degree), operator(x, x, span, degree)
    res = y - data @ y
    sigma = np.sqrt(res @ res / np.trace((np.eye(200) - data) @ (np.eye(200) - data).T))
    np.testing.assert_allclose(got.fitted, rows @ y, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(got.row_norm, np.linalg.norm(rows, axis=1), rtol=1e-6)
    np.testing.assert_allclose(got.se, sigma * np.linalg.norm(rows, axis=1), rtol=1e-6)
    np.testing.assert_allclose(got.upper - got.lower, 2 * 1.959963984540054 * got.se, rtol=1e-9)


@pytest.mark.parametrize("bins,finish", [(4, 3), (64, 10), (4096, 20_000)])
def test_neighbour_distance_with_hot_values_and_wide_ranges(spark, bins, finish):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(400, 1.5), rng.normal(size=300), 10.0 ** rng.uniform(-6, 6, 300)])
    red = loess._reduced(spark.createDataFrame(pd.DataFrame({"x": x, "y": x})), "x", "y")
    points = [float(x.min()), -0.3, 1.5, 2.0, 1e3, float(x.max())]
    for q in (1, 37, 450, 1000):
        want = [float(np.sort(np.abs(x - g))[q - 1]) for g in points]
        np.testing.assert_allclose(loess.neighbour_distance(red, points, q, bins, finish), want, rtol=1e-12)


def test_degenerate_inputs(spark):
    schema = "x double, y double"
    assert loess.loess_span(spark.createDataFrame([], schema), "x", "y").count() == 0
    assert loess.loess_span(spark.createDataFrame([(1.0, 2.0)] * 5, schema), "x", "y").count() == 0
    two = loess.loess_span(spark.createDataFrame([(0.0, 1.0), (1.0, 3.0)], schema), "x", "y", n_grid=3).collect()
    assert len(two) == 3 and all(r.fitted is None for r in two)
