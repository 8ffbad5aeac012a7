"""Registered queries: linear models, GLMs, evaluation and trends (ML1-ML13,
ML22-ML24, ML26, ML27), each with a closed-form SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit import constants as K
from panelkit.functions import dists, scalar as SC
from panelkit.models import evaluate as EV, glm, loess, ols
from panelkit.models.gram import compute_gram
from panelkit.operators import features as FE, panel as P
from panelkit.plans.registry import register
from panelkit.sources import tables as T

Z975 = dists.norm_ppf(0.975)
_D = "(SELECT l_orderkey, l_linenumber, ln(l_extendedprice) AS y, l_quantity, l_discount, l_tax, " \
     "l_returnflag, l_linestatus FROM lineitem)"


def lm_frame(spark, d):
    """L model frame: y = log extended price, numeric and factor predictors."""
    li = T.table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.ln("l_extendedprice").alias("y"), "l_quantity",
                     "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def count_frame(spark, d):
    """Entity-month count table (AG19) with a binary supplier attribute."""
    li = T.lineitem_panel(spark, d)
    m = P.monthly_rollup(li, "l_suppkey", "date", (F.col("l_quantity") > 25).cast("int"), {})
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    return m.join(s, "l_suppkey").withColumn("supplier_rich", (F.col("s_acctbal") > 4500).cast("int"))


_COUNTS = """c AS (SELECT l.l_suppkey, strftime(l.l_shipdate, '%Y-%m') AS ym,
                 CAST(sum(CAST(l.l_quantity > 25 AS INTEGER)) AS DOUBLE) AS y, CAST(count(*) AS DOUBLE) AS e
          FROM lineitem l GROUP BY 1, 2),
cg AS (SELECT c.*, CAST(s.s_acctbal > 4500 AS INTEGER) AS g FROM c JOIN supplier s ON c.l_suppkey = s.s_suppkey),
r AS (SELECT g, sum(y) AS sy, sum(e) AS se FROM cg GROUP BY g),
r0 AS (SELECT sy AS y0, se AS e0 FROM r WHERE g = 0), r1 AS (SELECT sy AS y1, se AS e1 FROM r WHERE g = 1),
pc AS (SELECT '(Intercept)' AS term, ln(y0 / e0) AS est, sqrt(1 / y0) AS se FROM r0
       UNION ALL SELECT 'supplier_rich', ln((y1 / e1) / (y0 / e0)), sqrt(1 / y1 + 1 / y0) FROM r0, r1)"""


def _poisson(spark, d):
    return glm.fit_glm(count_frame(spark, d), "n_high_days", ["supplier_rich"], "poisson",
                       offset="log_n_days")


_BIN = """b AS (SELECT CAST(l_quantity > 25 AS INTEGER) AS y, CAST(l_linestatus = 'O' AS INTEGER) AS g FROM lineitem),
t AS (SELECT g, CAST(sum(y) AS DOUBLE) AS pos, CAST(sum(1 - y) AS DOUBLE) AS neg FROM b GROUP BY g),
t0 AS (SELECT pos AS a0, neg AS b0 FROM t WHERE g = 0), t1 AS (SELECT pos AS a1, neg AS b1 FROM t WHERE g = 1),
lc AS (SELECT '(Intercept)' AS term, ln(a0 / b0) AS est, sqrt(1 / a0 + 1 / b0) AS se FROM t0
       UNION ALL SELECT 'l_linestatus_O', ln((a1 / b1) / (a0 / b0)), sqrt(1 / a0 + 1 / b0 + 1 / a1 + 1 / b1) FROM t0, t1)"""


def _logit(spark, d):
    li = T.table(spark, d, "lineitem").select(
        (F.col("l_quantity") > 25).cast("int").alias("y"), "l_linestatus")
    li, names = FE.dummy_columns(li, "l_linestatus", FE.factor_levels(li, "l_linestatus"))
    return glm.fit_glm(li, "y", names, "binomial", pearson=False)


@register("ols_univariate", " UNION ALL ".join(f"""
SELECT '{p}' AS predictor, CAST(regr_count(y, {p}) AS BIGINT) AS n, round(regr_slope(y, {p}), 8) AS slope,
       round(regr_intercept(y, {p}), 8) AS intercept, round(regr_r2(y, {p}), 8) AS r2,
       round(1 - (1 - regr_r2(y, {p})) * (regr_count(y, {p}) - 1) / (regr_count(y, {p}) - 2), 8) AS adj_r2,
       round(regr_r2(y, {p}) / (1 - regr_r2(y, {p})) * (regr_count(y, {p}) - 2), 3) AS f_stat
FROM {_D} d""" for p in ("l_quantity", "l_discount", "l_tax")))
def ols_univariate(spark, d):
    s = ols.univariate_sweep(lm_frame(spark, d), "y", ["l_quantity", "l_discount", "l_tax"])
    return s.select("predictor", "n", *[F.round(c, 8).alias(c) for c in ("slope", "intercept", "r2", "adj_r2")],
                    F.round("f_stat", 3).alias("f_stat"))


@register("ols_one_factor", f"""
WITH d AS {_D}, gm AS (SELECT l_returnflag AS g, avg(y) AS m, count(*) AS n FROM d GROUP BY 1),
s AS (SELECT sum((y - m) * (y - m)) AS sse, count(*) AS n FROM d JOIN gm ON d.l_returnflag = gm.g),
sig AS (SELECT sse / (n - 3) AS s2 FROM s), ref AS (SELECT m AS m0, n AS n0 FROM gm WHERE g = 'A')
SELECT '(Intercept)' AS term, round(m0, 6) AS estimate, round(sqrt(s2 / n0), 6) AS std_error,
       round(m0 / sqrt(s2 / n0), 4) AS t_value FROM ref, sig
UNION ALL
SELECT 'l_returnflag_' || g, round(m - m0, 6), round(sqrt(s2 * (1.0 / n + 1.0 / n0)), 6),
       round((m - m0) / sqrt(s2 * (1.0 / n + 1.0 / n0)), 4) FROM gm, ref, sig WHERE g <> 'A'
""")
def ols_one_factor(spark, d):
    df = lm_frame(spark, d)
    df, names = FE.dummy_columns(df, "l_returnflag", FE.factor_levels(df, "l_returnflag"))
    fit = ols.fit_ols(df, "y", names)
    t = fit.coef_table(spark)
    return t.select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"),
                    F.round("t_value", 4).alias("t_value"))


@register("ols_interaction", """
WITH g AS (SELECT l_returnflag AS f, regr_intercept(ln(l_extendedprice), l_quantity) AS a,
                  regr_slope(ln(l_extendedprice), l_quantity) AS b FROM lineitem GROUP BY 1),
r AS (SELECT a AS a0, b AS b0 FROM g WHERE f = 'A')
SELECT '(Intercept)' AS term, round(a0, 6) AS estimate FROM r
UNION ALL SELECT 'l_quantity', round(b0, 6) FROM r
UNION ALL SELECT 'l_returnflag_' || f, round(a - a0, 6) FROM g, r WHERE f <> 'A'
UNION ALL SELECT 'l_quantity_x_l_returnflag_' || f, round(b - b0, 6) FROM g, r WHERE f <> 'A'
""")
def ols_interaction(spark, d):
    df = lm_frame(spark, d)
    df, dn = FE.dummy_columns(df, "l_returnflag", FE.factor_levels(df, "l_returnflag"))
    df, inter = FE.interaction_columns(df, "l_quantity", dn)
    fit = ols.fit_ols(df, "y", ["l_quantity", *dn, *inter])
    return fit.coef_table(spark).select("term", F.round("estimate", 6).alias("estimate"))


@register("residuals_simple", f"""
WITH d AS {_D},
s AS (SELECT regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a, avg(l_quantity) AS mx,
             regr_sxx(y, l_quantity) AS sxx, count(*) AS n FROM d),
f AS (SELECT l_orderkey, l_linenumber, y, a + b * l_quantity AS fitted,
             1.0 / n + (l_quantity - mx) * (l_quantity - mx) / sxx AS h FROM d, s),
sig AS (SELECT sqrt(sum((y - fitted) * (y - fitted)) / (count(*) - 2)) AS sigma FROM f)
SELECT l_orderkey, l_linenumber, round(fitted, 6) AS fitted, round(y - fitted, 6) AS residual,
       round(h, 8) AS leverage, round((y - fitted) / (sigma * sqrt(1 - h)), 6) AS std_resid,
       round(pow((y - fitted) / (sigma * sqrt(1 - h)), 2) * h / (2 * (1 - h)), 8) AS cooks_d
FROM f, sig
""")
def residuals_simple(spark, d):
    df = lm_frame(spark, d)
    fit = ols.fit_ols(df, "y", ["l_quantity"])
    r = ols.diagnostics(df, fit, "y")
    return r.select("l_orderkey", "l_linenumber", F.round("fitted", 6).alias("fitted"),
                    F.round("residual", 6).alias("residual"), F.round("leverage", 8).alias("leverage"),
                    F.round("std_resid", 6).alias("std_resid"), F.round("cooks_d", 8).alias("cooks_d"))


@register("vif_two", """
WITH c AS (SELECT corr(l_quantity, l_discount) AS r FROM lineitem)
SELECT 'l_quantity' AS term, round(1 / (1 - r * r), 10) AS gvif, 1 AS df, round(sqrt(1 / (1 - r * r)), 10) AS gvif_adj FROM c
UNION ALL SELECT 'l_discount', round(1 / (1 - r * r), 10), 1, round(sqrt(1 / (1 - r * r)), 10) FROM c
""")
def vif_two(spark, d):
    g = compute_gram(lm_frame(spark, d), ["l_quantity", "l_discount"], "y")
    rows = ols.vif(g)
    t = spark.createDataFrame(rows, "term string, gvif double, df int, gvif_adj double")
    return t.select("term", F.round("gvif", 10).alias("gvif"), "df", F.round("gvif_adj", 10).alias("gvif_adj"))


@register("rmse_compare", " UNION ALL ".join(f"""
SELECT '{m}' AS model, round(sqrt(var_pop(y) * (1 - regr_r2(y, {p}))), 8) AS rmse,
       round(1 - (1 - regr_r2(y, {p})) * (count(*) - 1) / (count(*) - 2), 8) AS adj_r2
FROM {_D} d""" for m, p in (("y ~ l_quantity", "l_quantity"), ("y ~ l_discount", "l_discount"))))
def rmse_compare(spark, d):
    df = lm_frame(spark, d)
    rows = []
    for name, x in (("y ~ l_quantity", "l_quantity"), ("y ~ l_discount", "l_discount")):
        f = ols.fit_ols(df, "y", [x])
        rows.append((name, f.rmse, f.adj_r2))
    t = spark.createDataFrame(rows, "model string, rmse double, adj_r2 double")
    return t.select("model", F.round("rmse", 8).alias("rmse"), F.round("adj_r2", 8).alias("adj_r2"))


@register("poisson_one_factor", f"""
WITH {_COUNTS}
SELECT term, round(est, 6) AS estimate, round(se, 6) AS std_error, round(est / se, 4) AS z_value FROM pc
""")
def poisson_one_factor(spark, d):
    t = _poisson(spark, d).ratio_table(spark)
    return t.select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"),
                    F.round("z_value", 4).alias("z_value"))


@register("rate_ratio", f"""
WITH {_COUNTS}
SELECT term, round(exp(est), 6) AS rate_ratio, round(exp(est - {Z975!r} * se), 6) AS rr_ci_low,
       round(exp(est + {Z975!r} * se), 6) AS rr_ci_high FROM pc
""")
def rate_ratio(spark, d):
    t = _poisson(spark, d).ratio_table(spark, "rate_ratio", "rr")
    return t.select("term", *[F.round(c, 6).alias(c) for c in ("rate_ratio", "rr_ci_low", "rr_ci_high")])


_DISP = f"""WITH {_COUNTS},
f AS (SELECT cg.y, cg.e * (r.sy / r.se) AS mu FROM cg JOIN r ON cg.g = r.g),
dv AS (SELECT 2 * sum(CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0 END - (y - mu)) AS dev,
              sum((y - mu) * (y - mu) / mu) AS pearson, count(*) - 2 AS dfr FROM f)"""


@register("dispersion", _DISP + f"""
SELECT round(dev, 4) AS deviance, CAST(dfr AS DOUBLE) AS df_residual, round(dev / dfr, 6) AS deviance_ratio,
       round(pearson, 4) AS pearson_chi2, round(pearson / dfr, 6) AS pearson_ratio,
       CAST(dev / dfr > {K.OVERDISPERSION_FLAG} AS INTEGER) AS overdispersed FROM dv
""")
def dispersion(spark, d):
    row = glm.dispersion_row(_poisson(spark, d), K.OVERDISPERSION_FLAG)
    t = spark.createDataFrame([row])
    return t.select(F.round("deviance", 4).alias("deviance"), F.col("df_residual").cast("double"),
                    F.round("deviance_ratio", 6).alias("deviance_ratio"),
                    F.round("pearson_chi2", 4).alias("pearson_chi2"),
                    F.round("pearson_ratio", 6).alias("pearson_ratio"), F.col("overdispersed").cast("int"))


@register("quasi_compare", _DISP + """
SELECT term, round(est, 6) AS estimate_pois, round(se, 6) AS se_pois, round(est, 6) AS estimate_quasi,
       round(se * sqrt(pearson / dfr), 6) AS se_quasi FROM pc, dv
""")
def quasi_compare(spark, d):
    fit = _poisson(spark, d)
    rows = [(t, b, s, b, sq) for t, b, s, _p, sq, _tq, _pq in fit.quasi_rows()]
    t = spark.createDataFrame(rows, "term string, estimate_pois double, se_pois double, "
                                    "estimate_quasi double, se_quasi double")
    return t.select("term", *[F.round(c, 6).alias(c) for c in t.columns[1:]])


@register("logit_one_factor", f"""
WITH {_BIN}
SELECT term, round(est, 6) AS estimate, round(se, 6) AS std_error, round(est / se, 4) AS z_value FROM lc
""")
def logit_one_factor(spark, d):
    t = _logit(spark, d).ratio_table(spark, "odds_ratio", "or")
    return t.select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"),
                    F.round("z_value", 4).alias("z_value"))


@register("odds_ratio", f"""
WITH {_BIN}
SELECT term, round(exp(est), 6) AS odds_ratio, round(exp(est - {Z975!r} * se), 6) AS or_ci_low,
       round(exp(est + {Z975!r} * se), 6) AS or_ci_high,
       CAST(abs(est / se) > {Z975!r} AS INTEGER) AS significant FROM lc
""")
def odds_ratio(spark, d):
    t = _logit(spark, d).ratio_table(spark, "odds_ratio", "or")
    return t.select("term", *[F.round(c, 6).alias(c) for c in ("odds_ratio", "or_ci_low", "or_ci_high")],
                    (F.abs("z_value") > Z975).cast("int").alias("significant"))


_CM = ("(SELECT CAST(l_quantity > 25 AS INTEGER) AS label, CAST(l_discount >= 0.05 AS INTEGER) AS pred "
       "FROM lineitem)")


@register("class_metrics", f"""
WITH c AS (SELECT CAST(count(*) FILTER (WHERE pred = 1 AND label = 1) AS DOUBLE) AS tp,
                  CAST(count(*) FILTER (WHERE pred = 0 AND label = 0) AS DOUBLE) AS tn,
                  CAST(count(*) FILTER (WHERE pred = 1 AND label = 0) AS DOUBLE) AS fp,
                  CAST(count(*) FILTER (WHERE pred = 0 AND label = 1) AS DOUBLE) AS fn FROM {_CM} x),
m AS (SELECT *, tp + tn + fp + fn AS n, tp / (tp + fn) AS sens, tn / (tn + fp) AS spec, tp / (tp + fp) AS prec,
             ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + tn + fp + fn) * (tp + tn + fp + fn)) AS pe FROM c)
SELECT CAST(tp AS BIGINT) AS tp, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       round((tp + tn) / n, 10) AS accuracy, round(sens, 10) AS sensitivity, round(spec, 10) AS specificity,
       round(prec, 10) AS precision, round(2 * prec * sens / (prec + sens), 10) AS f1,
       round(((tp + tn) / n - pe) / (1 - pe), 10) AS kappa, round((tp + fn) / n, 10) AS prevalence,
       round(tn / (tn + fn), 10) AS npv, round((sens + spec) / 2, 10) AS balanced_accuracy FROM m
""")
def class_metrics(spark, d):
    li = T.table(spark, d, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("label"),
                                              (F.col("l_discount") >= 0.05).cast("int").alias("pred"))
    m = EV.class_metrics(li, "label", "pred")
    return m.select("tp", "tn", "fp", "fn", *[F.round(c, 10).alias(c) for c in m.columns[4:]])


@register("reg_metrics", f"""
WITH d AS {_D}, s AS (SELECT regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a FROM d),
p AS (SELECT y, a + b * l_quantity AS yhat FROM d, s)
SELECT round(sqrt(avg((y - yhat) * (y - yhat))), 8) AS rmse, round(avg(abs(y - yhat)), 8) AS mae,
       count(*) AS n, round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 8) AS r2,
       round(sqrt(avg(pow(exp(y) - exp(yhat), 2))), 4) AS rmse_orig, round(avg(abs(exp(y) - exp(yhat))), 4) AS mae_orig,
       round(avg(abs(exp(y) - exp(yhat))) * 100 / median(exp(y)), 6) AS mae_pct_of_median FROM p
""")
def reg_metrics(spark, d):
    df = lm_frame(spark, d)
    fit = ols.fit_ols(df, "y", ["l_quantity"])
    m = EV.reg_metrics(df.withColumn("yhat", fit.predict()), "y", "yhat", back_transform=True)
    return m.select(F.round("rmse", 8).alias("rmse"), F.round("mae", 8).alias("mae"), "n",
                    F.round("r2", 8).alias("r2"), F.round("rmse_orig", 4).alias("rmse_orig"),
                    F.round("mae_orig", 4).alias("mae_orig"),
                    F.round("mae_pct_of_median", 6).alias("mae_pct_of_median"))


@register("score_quartiles", """
SELECT CAST(l_quantity > 25 AS INTEGER) AS label, min(l_discount) AS min,
       round(quantile_cont(l_discount, 0.25), 8) AS q1, round(quantile_cont(l_discount, 0.5), 8) AS median,
       round(quantile_cont(l_discount, 0.75), 8) AS q3, max(l_discount) AS max
FROM lineitem GROUP BY 1
""")
def score_quartiles(spark, d):
    li = T.table(spark, d, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("label"), "l_discount")
    q = EV.score_quartiles(li, "label", "l_discount")
    return q.select("label", "min", *[F.round(c, 8).alias(c) for c in ("q1", "median", "q3")], "max")


@register("loess_grid", """
WITH d AS (SELECT l_quantity AS x, ln(l_extendedprice) AS y FROM lineitem),
rng AS (SELECT min(x) AS lo, max(x) AS hi FROM d),
red AS (SELECT x, CAST(count(*) AS DOUBLE) AS c, sum(y) AS sy FROM d GROUP BY x),
g AS (SELECT CAST(i AS INTEGER) AS grid_idx, lo + i * ((hi - lo) / 20) AS gx, (hi - lo) * 0.3 AS h FROM rng, range(21) t(i)),
p AS (SELECT grid_idx, gx, x - gx AS dd, pow(1 - pow(abs(x - gx) / h, 3), 3) AS k, c, sy
      FROM red JOIN g ON abs(x - gx) / h < 1),
s AS (SELECT grid_idx, gx, sum(k * c) AS S0, sum(k * c * dd) AS S1, sum(k * c * dd * dd) AS S2,
             sum(k * c * pow(dd, 3)) AS S3, sum(k * c * pow(dd, 4)) AS S4,
             sum(k * sy) AS T0, sum(k * sy * dd) AS T1, sum(k * sy * dd * dd) AS T2 FROM p GROUP BY 1, 2)
SELECT grid_idx, round(gx, 6) AS x,
       round((T0 * (S2 * S4 - S3 * S3) - S1 * (T1 * S4 - S3 * T2) + S2 * (T1 * S3 - S2 * T2))
             / (S0 * (S2 * S4 - S3 * S3) - S1 * (S1 * S4 - S3 * S2) + S2 * (S1 * S3 - S2 * S2)), 6) AS fitted,
       round(S0, 6) AS weight_sum
FROM s
""")
def loess_grid(spark, d):
    li = T.table(spark, d, "lineitem").select("l_quantity", F.ln("l_extendedprice").alias("y"))
    g = loess.loess_grid(li, "l_quantity", "y", 21, 0.3, 2)
    return g.select("grid_idx", F.round("x", 6).alias("x"), F.round("fitted", 6).alias("fitted"),
                    F.round("weight_sum", 6).alias("weight_sum"))


@register("loess_span", """
WITH dm AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS y FROM lineitem GROUP BY 1),
d AS (SELECT CAST(date_diff('day', DATE '1995-01-01', date) AS DOUBLE) AS x, y FROM dm),
rng AS (SELECT min(x) AS lo, max(x) AS hi, CAST(floor(count(*) * 0.1 + 1e-5) AS BIGINT) AS q, count(*) AS n FROM d),
g AS (SELECT CAST(i AS INTEGER) AS i, lo + i * ((hi - lo) / 79) AS gx, q FROM rng, range(80) t(i)),
r AS (SELECT i, gx, x - gx AS dd, y, row_number() OVER (PARTITION BY i ORDER BY abs(x - gx)) AS nr, q FROM d, g),
h AS (SELECT i, max(abs(dd)) AS h FROM r WHERE nr <= q GROUP BY i),
w AS (SELECT r.i, gx, h, dd / h AS u, y, pow(1 - pow(abs(dd) / h, 3), 3) AS k FROM r JOIN h ON r.i = h.i WHERE abs(dd) < h),
s AS (SELECT i, gx, h, sum(k) AS S0, sum(k * u) AS S1, sum(k * u * u) AS S2, sum(k * pow(u, 3)) AS S3, sum(k * pow(u, 4)) AS S4,
             sum(k * y) AS T0, sum(k * y * u) AS T1, sum(k * y * u * u) AS T2,
             sum(k * k) AS U0, sum(k * k * u) AS U1, sum(k * k * u * u) AS U2, sum(k * k * pow(u, 3)) AS U3, sum(k * k * pow(u, 4)) AS U4
      FROM w GROUP BY i, gx, h),
a AS (SELECT *, S0 * (S2 * S4 - S3 * S3) - S1 * (S1 * S4 - S3 * S2) + S2 * (S1 * S3 - S2 * S2) AS det FROM s),
c AS (SELECT *, (S2 * S4 - S3 * S3) / det AS a0, (S2 * S3 - S1 * S4) / det AS a1, (S1 * S3 - S2 * S2) / det AS a2 FROM a),
f AS (SELECT i, gx, h, a0 * T0 + a1 * T1 + a2 * T2 AS fitted, a0 AS lev,
             a0 * a0 * U0 + 2 * a0 * a1 * U1 + (a1 * a1 + 2 * a0 * a2) * U2 + 2 * a1 * a2 * U3 + a2 * a2 * U4 AS norm2 FROM c),
p AS (SELECT x, y, least(floor((x - lo) / ((hi - lo) / 79)), 78) AS k, (x - lo) / ((hi - lo) / 79) AS pos FROM d, rng),
e AS (SELECT y - (f0.fitted * (1 - (pos - k)) + f1.fitted * (pos - k)) AS res, f0.lev * (1 - (pos - k)) + f1.lev * (pos - k) AS lev,
             f0.norm2 * (1 - (pos - k)) + f1.norm2 * (pos - k) AS norm2 FROM p JOIN f f0 ON f0.i = k JOIN f f1 ON f1.i = k + 1),
sg AS (SELECT sqrt(sum(res * res) / (count(*) - 2 * sum(lev) + sum(norm2))) AS sigma FROM e)
SELECT i AS grid_idx, round(gx, 6) AS x, round(h, 6) AS bandwidth, round(fitted, 6) AS fitted, round(sqrt(norm2), 6) AS row_norm,
       round(sigma * sqrt(norm2), 6) AS se FROM f, sg
""")
def loess_span(spark, d):
    """Daily mean quantity smoothed over the nearest tenth of the days, with its standard error."""
    dm = T.lineitem_panel(spark, d).groupBy("date").agg(F.avg("l_quantity").alias("y"))
    t = dm.select(F.datediff("date", F.lit("1995-01-01").cast("date")).cast("double").alias("x"), "y")
    g = loess.loess_span(t, "x", "y", span=0.1, n_grid=80)
    return g.select("grid_idx", *[F.round(c, 6).alias(c) for c in ("x", "bandwidth", "fitted", "row_norm", "se")])


@register("trend_line", """
WITH dm AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS y FROM lineitem GROUP BY 1),
t AS (SELECT date_diff('day', (SELECT min(date) FROM dm), date) AS x, y FROM dm),
s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx, count(*) AS n,
             regr_r2(y, x) AS r2 FROM t),
e AS (SELECT sum(pow(y - (a + b * x), 2)) AS sse FROM t, s)
SELECT round(b, 10) AS slope, round(a, 8) AS intercept, round(sqrt(sse / (n - 2) / sxx), 10) AS se_slope,
       n, round(r2, 8) AS r2 FROM s, e
""")
def trend_line(spark, d):
    li = T.lineitem_panel(spark, d)
    dm = li.groupBy("date").agg(F.avg("l_quantity").alias("y"))
    first = dm.agg(F.min("date").alias("_d0"))
    t = dm.crossJoin(F.broadcast(first)).select(F.datediff("date", "_d0").cast("double").alias("x"), "y")
    fit = ols.fit_ols(t, "y", ["x"])
    rows = fit.coef_rows()
    se_slope = rows[1][2]
    out = spark.createDataFrame([(float(fit.coef[1]), float(fit.coef[0]), float(se_slope), int(fit.n), fit.r2)],
                                "slope double, intercept double, se_slope double, n long, r2 double")
    return out.select(F.round("slope", 10).alias("slope"), F.round("intercept", 8).alias("intercept"),
                      F.round("se_slope", 10).alias("se_slope"), "n", F.round("r2", 8).alias("r2"))


def _sql_horner(coefs, x):
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"({out}) * {x} + {c!r}"
    return out


def _sql_probit(p):
    a, b, c, dd, lo = SC._PROBIT_A, SC._PROBIT_B, SC._PROBIT_C, SC._PROBIT_D, SC._PROBIT_LOW
    r = f"(({p}) - 0.5) * (({p}) - 0.5)"
    central = f"({_sql_horner(a, r)}) * (({p}) - 0.5) / (({_sql_horner(b, r)}) * {r} + 1)"
    ql = f"sqrt(-2 * ln({p}))"
    qu = f"sqrt(-2 * ln(1 - ({p})))"
    low = f"({_sql_horner(c, ql)}) / (({_sql_horner(dd, ql)}) * {ql} + 1)"
    high = f"-({_sql_horner(c, qu)}) / (({_sql_horner(dd, qu)}) * {qu} + 1)"
    return f"CASE WHEN ({p}) < {lo!r} THEN {low} WHEN ({p}) > {1 - lo!r} THEN {high} ELSE {central} END"


@register("qq_points", f"""
WITH d AS {_D},
s AS (SELECT regr_slope(y, l_quantity) AS b, regr_intercept(y, l_quantity) AS a, avg(l_quantity) AS mx,
             regr_sxx(y, l_quantity) AS sxx, count(*) AS n FROM d),
f AS (SELECT l_orderkey, l_linenumber, y - (a + b * l_quantity) AS res,
             1.0 / n + (l_quantity - mx) * (l_quantity - mx) / sxx AS h, n FROM d, s),
sig AS (SELECT sqrt(sum(res * res) / (count(*) - 2)) AS sigma FROM f),
z AS (SELECT l_orderkey, l_linenumber, res / (sigma * sqrt(1 - h)) AS std_resid, n FROM f, sig),
r AS (SELECT *, row_number() OVER (ORDER BY std_resid, l_orderkey, l_linenumber) AS i FROM z)
SELECT l_orderkey, l_linenumber, round(std_resid, 6) AS std_resid,
       round({_sql_probit("(i - 0.5) / n")}, 6) AS theoretical
FROM r
""")
def qq_points(spark, d):
    df = lm_frame(spark, d)
    fit = ols.fit_ols(df, "y", ["l_quantity"])
    r = ols.diagnostics(df, fit, "y").select("l_orderkey", "l_linenumber", "std_resid")
    q = ols.qq_points(r, "std_resid", ["l_orderkey", "l_linenumber"])
    return q.select("l_orderkey", "l_linenumber", F.round("std_resid", 6).alias("std_resid"),
                    F.round("theoretical", 6).alias("theoretical"))


@register("ols_score", """
WITH c AS (SELECT count(*) AS n, avg(ln(l_extendedprice)) AS mean_y FROM lineitem)
SELECT term, CAST(0 AS DOUBLE) AS mean_score, n, round(mean_y, 8) AS mean_fitted
FROM c, (VALUES ('(Intercept)'), ('l_quantity'), ('l_discount'), ('l_tax'), ('l_returnflag_N'), ('l_returnflag_R')) t(term)
""")
def ols_score(spark, d):
    """The normal equations of the multiple fit behind ``ols_coef_ci``: the mean
    of residual times column is 0 for every term."""
    df = lm_frame(spark, d)
    df, dn = FE.dummy_columns(df, "l_returnflag", FE.factor_levels(df, "l_returnflag"))
    fit = ols.fit_ols(df, "y", ["l_quantity", "l_discount", "l_tax", *dn])
    left = df.withColumn("_fit", fit.predict())
    one = left.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("_fit"), 8).alias("mean_fitted"), *[
        F.abs(F.round(F.avg((F.col("y") - F.col("_fit")) * (F.lit(1.0) if t == ols.INTERCEPT else F.col(t))), 6)).alias(f"s{i}")
        for i, t in enumerate(fit.terms)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"s{i}").alias("mean_score"), F.col("n"), F.col("mean_fitted"))
                                         for i, t in enumerate(fit.terms)])))


@register("ols_coef_ci")
def ols_coef_ci(spark, d):
    """Multiple OLS with t-based 95 % intervals and p-values (ML2, ML6)."""
    df = lm_frame(spark, d)
    df, dn = FE.dummy_columns(df, "l_returnflag", FE.factor_levels(df, "l_returnflag"))
    fit = ols.fit_ols(df, "y", ["l_quantity", "l_discount", "l_tax", *dn])
    summ = fit.summary_row()
    return fit.coef_table(spark).withColumns({k: F.lit(float(v)) for k, v in summ.items()})
