"""Local polynomial (LOESS-style) trend on a fixed grid (ML26).

Tricube weights with a fixed bandwidth ``h`` (a fraction of the x range),
local quadratic (or linear) fit evaluated at each grid point.  Rows are
first reduced to distinct x values (or ``bins`` equal-width bins) with
counts and sums of y; each reduced row is paired only with the grid points
within ``h`` (a band join: the candidate grid indices are a short sequence
exploded per row, then an equi-join on the index), so the work is
(distinct x) x (grid points per bandwidth), never rows x grid.

``loess_span`` takes the nearest share of the rows instead of a fixed bandwidth
and adds the standard error.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.functions import dists
from panelkit.sources.io import checkpoint_table


def loess_grid(df: DataFrame, x: str, y: str, n_grid: int = 21, bandwidth_frac: float = 0.3,
               degree: int = 2, bins: int | None = None) -> DataFrame:
    """``(grid_idx, x, fitted, weight_sum)`` for ``n_grid`` points over [min x, max x]."""
    d = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    rng = d.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    if bins:
        w = (F.col("_hi") - F.col("_lo")) / bins
        b = F.least(F.floor((F.col("_x") - F.col("_lo")) / w), F.lit(bins - 1))
        d = d.crossJoin(F.broadcast(rng)).withColumn("_x", F.col("_lo") + (b + 0.5) * w).drop("_lo", "_hi")
    red = d.groupBy("_x").agg(F.count(F.lit(1)).cast("double").alias("_c"), F.sum("_y").alias("_sy"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(n_grid - 1)
    h = (F.col("_hi") - F.col("_lo")) * F.lit(bandwidth_frac)
    k_lo = F.greatest(F.ceil((F.col("_x") - h - F.col("_lo")) / step), F.lit(0)).cast("int")
    k_hi = F.least(F.floor((F.col("_x") + h - F.col("_lo")) / step), F.lit(n_grid - 1)).cast("int")
    pairs = (red.crossJoin(F.broadcast(rng))
             .withColumn("grid_idx", F.explode(F.sequence(k_lo, k_hi)))
             .withColumn("_g", F.col("_lo") + F.col("grid_idx") * step)
             .withColumn("_d", F.col("_x") - F.col("_g"))
             .withColumn("_u", F.abs("_d") / h)
             .where(F.col("_u") < 1)
             .withColumn("_w", F.pow(1 - F.pow(F.col("_u"), 3), 3) * F.col("_c"))
             .withColumn("_wy", F.pow(1 - F.pow(F.col("_u"), 3), 3) * F.col("_sy")))
    sums = pairs.groupBy("grid_idx", "_g").agg(
        *[F.sum(F.col("_w") * F.pow(F.col("_d"), k)).alias(f"S{k}") for k in range(5)],
        *[F.sum(F.col("_wy") * F.pow(F.col("_d"), k)).alias(f"T{k}") for k in range(3)])
    S = [F.col(f"S{k}") for k in range(5)]
    T = [F.col(f"T{k}") for k in range(3)]
    if degree == 2:
        det = S[0] * (S[2] * S[4] - S[3] * S[3]) - S[1] * (S[1] * S[4] - S[3] * S[2]) \
            + S[2] * (S[1] * S[3] - S[2] * S[2])
        num = T[0] * (S[2] * S[4] - S[3] * S[3]) - S[1] * (T[1] * S[4] - S[3] * T[2]) \
            + S[2] * (T[1] * S[3] - S[2] * T[2])
    else:
        det = S[0] * S[2] - S[1] * S[1]
        num = T[0] * S[2] - S[1] * T[1]
    return sums.select("grid_idx", F.col("_g").alias("x"), F.try_divide(num, det).alias("fitted"),
                       S[0].alias("weight_sum"))


#: bins of the global count; candidates left per point before they are ordered
SPAN_BINS = 4096
SPAN_FINISH = 20_000


def _reduced(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct x with count, sum of y and sum of y squared."""
    d = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna()
    d = d.where(~F.isnan("_x") & ~F.isnan("_y"))
    return checkpoint_table(d.groupBy("_x").agg(F.count(F.lit(1)).alias("_c"), F.sum("_y").alias("_sy"), F.sum(F.col("_y") * F.col("_y")).alias("_syy")),
                            "loess_x")


def _bin_of(lo: float, hi: float, bins: int):
    width = (hi - lo) / bins if hi > lo else 1.0
    return width, lambda c: F.least(F.floor((c - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def neighbour_distance(red: DataFrame, points: Sequence[float], q: int, bins: int = SPAN_BINS, finish: int = SPAN_FINISH) -> list[float]:
    """Distance from each point to its q-th nearest row of the counted distinct x.

    A two-sided rank search: one histogram of x brackets every point's distance
    to within a bin on either side; only the x in those bins are read again,
    narrowed by counts over distance until few are left, and put in order."""
    spark = red.sparkSession
    lo, hi, n = red.agg(F.min("_x"), F.max("_x"), F.sum("_c")).first()
    if n is None or q > n or q < 1:
        raise ValueError("fewer rows than neighbours")
    width, bin_of = _bin_of(lo, hi, bins)
    held = np.zeros(bins, dtype=np.int64)
    for b, c in red.groupBy(bin_of(F.col("_x")).alias("b")).agg(F.sum("_c")).collect():       # at most ``bins`` rows
        held[b] = c
    left, right = lo + width * np.arange(bins), lo + width * np.arange(1, bins + 1)
    asked, base = [], []
    for i, g in enumerate(points):
        near = np.where(g < left, left - g, np.where(g > right, g - right, 0.0))      # least and greatest distance in a bin
        far = np.maximum(np.abs(left - g), np.abs(right - g))
        order = np.argsort(far, kind="stable")
        reach = far[order][np.searchsorted(np.cumsum(held[order]), q)] * (1 + 1e-12) + 1e-300   # so many rows lie at most this far
        order = np.argsort(near, kind="stable")
        # fewer than q rows lie nearer than the near side of the bin where the count by near sides gets there
        least = near[order][np.searchsorted(np.cumsum(held[order]), q)]
        sure = (far < least * (1 - 1e-12)) & (held > 0)
        base.append(int(held[sure].sum()))
        asked += [(i, float(g), int(b)) for b in np.flatnonzero(~sure & (near <= reach) & (held > 0))]
    wanted = spark.createDataFrame(asked, "_i int, _g double, _b int")                         # a few bins per point
    found = (red.withColumn("_b", bin_of(F.col("_x"))).join(F.broadcast(wanted), "_b")
             .groupBy("_i", F.abs(F.col("_x") - F.col("_g")).alias("_d")).agg(F.sum("_c").alias("_c")))
    found = checkpoint_table(found, "loess_near")
    need = {i: q - b for i, b in enumerate(base)}
    while True:
        sizes = {r[0]: r[1:] for r in found.groupBy("_i").agg(F.count(F.lit(1)), F.min("_d"), F.max("_d")).collect()}
        if all(s[0] <= finish or s[1] == s[2] for s in sizes.values()):
            break
        ranges = spark.createDataFrame([(i, s[1], s[2]) for i, s in sizes.items()], "_i int, _lo double, _hi double")
        step = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("_d") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * 1024), F.lit(1023))).otherwise(0)
        cut = found.join(F.broadcast(ranges), "_i").withColumn("_s", step.cast("int"))
        keep = []
        by_point: dict[int, list] = {}
        for i, s, c in cut.groupBy("_i", "_s").agg(F.sum("_c")).collect():                     # 1024 rows per point
            by_point.setdefault(i, []).append((s, c))
        for i, counts in by_point.items():
            for s, c in sorted(counts):
                if need[i] <= c:
                    keep.append((i, s))
                    break
                need[i] -= c
        found = checkpoint_table(cut.join(F.broadcast(spark.createDataFrame(keep, "_i int, _s int")), ["_i", "_s"]).select("_i", "_d", "_c"), "loess_near")
    order = Window.partitionBy("_i").orderBy("_d")
    table = spark.createDataFrame(list(need.items()), "_i int, _need long")
    hit = (found.withColumn("_cum", F.sum("_c").over(order)).join(F.broadcast(table), "_i").where(F.col("_cum") >= F.col("_need"))
           .groupBy("_i").agg(F.min("_d")))
    by_index = dict(hit.collect())
    return [float(by_index[i]) for i in range(len(points))]


def loess_span(df: DataFrame, x: str, y: str, span: float = 0.75, n_grid: int = 80, degree: int = 2, level: float = 0.95,
               points: Sequence[float] | None = None) -> DataFrame:
    """LOESS with a nearest-neighbour span and its standard error: ``(grid_idx,
    x, bandwidth, fitted, row_norm, leverage, se, lower, upper)``.

    Each evaluation point takes the ``floor(n * span)`` nearest rows (tricube in
    their greatest distance; a span over 1 stretches it). The fit is linear in y;
    the same aggregation that gives the fit's moments gives the moments of the
    squared weights, hence the norm of the operator's row. The residual variance
    divides the squared residuals by n - 2 tr(L) + tr(L L'), fit, leverage and
    norm between evaluation points being read off linearly. ``points`` replaces
    the grid over [min x, max x] (given at all distinct x, nothing is read off
    between). Rows with a NULL or NaN are left out; constant x has no fit."""
    spark = df.sparkSession
    red = _reduced(df, x, y)
    lo, hi, n = red.agg(F.min("_x"), F.max("_x"), F.sum("_c")).first()
    schema = "grid_idx int, x double, bandwidth double, fitted double, row_norm double, leverage double, se double, lower double, upper double"
    if n is None or lo == hi:
        return spark.createDataFrame([], schema)
    at = sorted(float(p) for p in points) if points is not None else [lo + i * ((hi - lo) / (n_grid - 1)) for i in range(n_grid)]
    q = min(n, max(1, int(np.floor(n * span + 1e-5))))
    stretch = max(1.0, span)
    h = [d * stretch for d in neighbour_distance(red, at, q)]
    width, bin_of = _bin_of(lo, hi, SPAN_BINS)
    pairs = []
    for i, (g, r) in enumerate(zip(at, h)):
        first, last = (int(min(max((v - lo) // width, 0), SPAN_BINS - 1)) for v in (g - r, g + r))
        pairs.append((i, g, r, max(first - 1, 0), min(last + 1, SPAN_BINS - 1)))
    near = spark.createDataFrame(pairs, "_i int, _g double, _h double, _b0 int, _b1 int")
    near = near.withColumn("_b", F.explode(F.sequence("_b0", "_b1"))).drop("_b0", "_b1")        # points x bins at most
    d = (red.withColumn("_b", bin_of(F.col("_x"))).join(F.broadcast(near), "_b")
         .withColumn("_d", F.col("_x") - F.col("_g")).where(F.abs("_d") < F.col("_h"))
         .withColumn("_w", F.pow(1 - F.pow(F.abs("_d") / F.col("_h"), 3), 3)))
    # moments in the distance over the bandwidth, so that their sizes stay alike
    u = F.col("_d") / F.col("_h")
    sums = d.groupBy("_i").agg(*[F.sum(F.col("_w") * F.col("_c") * F.pow(u, k)).alias(f"S{k}") for k in range(2 * degree + 1)],
                               *[F.sum(F.col("_w") * F.col("_sy") * F.pow(u, k)).alias(f"T{k}") for k in range(degree + 1)],
                               *[F.sum(F.col("_w") * F.col("_w") * F.col("_c") * F.pow(u, k)).alias(f"U{k}") for k in range(2 * degree + 1)])
    m = degree + 1
    fits = {}
    for r in sums.collect():                                                                   # one row per evaluation point
        s = np.array([[r[f"S{a + b}"] for b in range(m)] for a in range(m)])
        if np.linalg.matrix_rank(s, tol=1e-10 * max(abs(s).max(), 1e-300)) < m:
            continue
        a = np.linalg.solve(s, np.eye(m)[0])
        norm2 = sum(a[j] * a[k] * r[f"U{j + k}"] for j in range(m) for k in range(m))
        fits[r["_i"]] = (float(a @ [r[f"T{k}"] for k in range(m)]), float(norm2), float(a[0]))
    known = sorted(fits)
    sigma = None
    if len(known) > 1:
        cells = [(k, at[i], at[j], *fits[i], *fits[j]) for k, (i, j) in enumerate(zip(known, known[1:]))]
        table = spark.createDataFrame(cells, "_k int, _l double, _r double, f0 double, n0 double, v0 double, f1 double, n1 double, v1 double")
        edges = F.array(*[F.lit(c[1]) for c in cells])
        cell = F.greatest(F.size(F.filter(edges, lambda e: e <= F.col("_x"))) - 1, F.lit(0))
        t = F.least(F.greatest((F.col("_x") - F.col("_l")) / (F.col("_r") - F.col("_l")), F.lit(0.0)), F.lit(1.0))

        def read(name):
            return F.col(f"{name}0") * (1 - t) + F.col(f"{name}1") * t
        on = red.withColumn("_k", cell).join(F.broadcast(table), "_k")
        rss, lev, norm2 = on.agg(F.sum(F.col("_syy") - 2 * read("f") * F.col("_sy") + F.col("_c") * read("f") * read("f")),
                                 F.sum(F.col("_c") * read("v")), F.sum(F.col("_c") * read("n"))).first()
        free = n - 2 * lev + norm2
        sigma = float(np.sqrt(max(rss, 0.0) / free)) if free > 0 else None
    z = dists.norm_ppf(0.5 + level / 2)
    rows = []
    for i, (g, r) in enumerate(zip(at, h)):
        f, norm2, lev = fits.get(i, (None, None, None))
        se = sigma * norm2 ** 0.5 if sigma is not None and f is not None else None
        rows.append((i, g, float(r), f, None if f is None else norm2 ** 0.5, lev, se, None if se is None else f - z * se, None if se is None else f + z * se))
    return spark.createDataFrame(rows, schema)
