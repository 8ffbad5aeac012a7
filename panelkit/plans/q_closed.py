"""Registered queries that hold model tables and sinks against closed forms in
SQL: the sweep's p-values (ML1), GVIF of a factor (ML5), t intervals (ML6), a
saved and reloaded model's scores (IO5, ML21), a CSV export read back (IO4) and
the observed / fitted extract (CH6)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelkit.models import glm, ols
from panelkit.models.gram import compute_gram
from panelkit.operators import features as FE
from panelkit.plans.q_models import lm_frame
from panelkit.plans.registry import register
from panelkit.session import checkpoint_dir
from panelkit.sources import io, tables as T

_Y = "(SELECT ln(l_extendedprice) AS y, l_quantity, l_discount, l_tax, CAST(l_linestatus = 'O' AS INTEGER) AS l_linestatus, l_returnflag FROM lineitem)"

# two-sided Student tail = 1 - integral of the density over [-t, t] (Simpson, 4,000 steps); beyond t = 40 it is 0 to 6 places
_SWEEP = " UNION ALL ".join(f"SELECT '{p}' AS predictor, CAST(regr_count(y, {p}) AS BIGINT) AS n, regr_r2(y, {p}) AS r2 FROM {_Y} d"
                            for p in ("l_quantity", "l_discount", "l_tax", "l_linestatus"))


@register("ols_sweep_pvalues", f"""
WITH s AS ({_SWEEP}), f AS (SELECT *, n - 2 AS v, least(40, sqrt(r2 / (1 - r2) * (n - 2))) AS t FROM s),
k AS (SELECT unnest(range(0, 4001)) AS k),
i AS (SELECT predictor, sum((CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)
                            * exp(-(v + 1) / 2.0 * ln(1 + (t * k / 4000) * (t * k / 4000) / v))) * t / 12000 AS area FROM f, k GROUP BY predictor, t),
one AS (SELECT f.predictor, n, r2, 1 - 2 * area * exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(v * pi()) AS p FROM f JOIN i ON f.predictor = i.predictor),
g AS (SELECT avg(y) AS m, count(*) AS n FROM {_Y} d GROUP BY l_returnflag), a AS (SELECT avg(y) AS m, var_pop(y) AS v, count(*) AS n FROM {_Y} d),
b AS (SELECT a.n, sum(g.n * (g.m - a.m) * (g.m - a.m)) / (a.v * a.n) AS r2 FROM g, a GROUP BY a.n, a.v)
SELECT predictor, n, round(r2, 8) AS r2, abs(round(p, 6)) AS p_value FROM one
UNION ALL SELECT 'l_returnflag', n, round(r2, 8), round(pow(1 + r2 / (1 - r2), -(n - 3) / 2.0), 6) FROM b
""")
def ols_sweep_pvalues(spark, d):
    """F-test p-value of every predictor's own regression, factors by their level means."""
    s = ols.univariate_sweep(lm_frame(spark, d), "y", ["l_quantity", "l_discount", "l_tax"], ["l_linestatus", "l_returnflag"])
    return s.select("predictor", "n", F.round("r2", 8).alias("r2"), F.abs(F.round("p_value", 6)).alias("p_value"))


@register("gvif_factor", """
WITH d AS (SELECT l_quantity AS q, CAST(l_returnflag = 'N' AS INTEGER) AS a, CAST(l_returnflag = 'R' AS INTEGER) AS b FROM lineitem),
r AS (SELECT corr(a, b) AS ab, corr(a, q) AS aq, corr(b, q) AS bq FROM d),
g AS (SELECT (1 - ab * ab) / (1 + 2 * ab * aq * bq - ab * ab - aq * aq - bq * bq) AS gvif FROM r)
SELECT 'l_quantity' AS term, round(gvif, 8) AS gvif, 1 AS df, round(sqrt(gvif), 8) AS gvif_scaled FROM g
UNION ALL SELECT 'l_returnflag', round(gvif, 8), 2, round(pow(gvif, 0.25), 8) FROM g
""")
def gvif_factor(spark, d):
    """Generalised variance inflation of a number and a three-level factor."""
    li, names = FE.dummy_columns(lm_frame(spark, d), "l_returnflag", ["A", "N", "R"])
    rows = ols.vif(compute_gram(li, ["l_quantity", *names], "y"), {"l_returnflag": names})
    t = spark.createDataFrame(rows, "term string, gvif double, df int, gvif_scaled double")
    return t.select("term", F.round("gvif", 8).alias("gvif"), "df", F.round("gvif_scaled", 8).alias("gvif_scaled"))


# t quantile by its expansion in 1 / v about the normal one (v is in the thousands)
@register("ols_ci_one_factor", """
WITH d AS (SELECT ln(l_extendedprice) AS y, l_returnflag AS g FROM lineitem), gm AS (SELECT g, avg(y) AS m, count(*) AS n FROM d GROUP BY g),
s AS (SELECT sum((y - m) * (y - m)) AS sse, count(*) - 3 AS v FROM d JOIN gm ON d.g = gm.g), z AS (SELECT 1.959963984540054::DOUBLE AS z),
q AS (SELECT sse / v AS s2, z + (z * z * z + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96.0 * v * v) AS q FROM s, z),
ref AS (SELECT m AS m0, n AS n0 FROM gm WHERE g = 'A'),
e AS (SELECT '(Intercept)' AS term, m0 AS est, sqrt(s2 / n0) AS se FROM ref, q
      UNION ALL SELECT 'l_returnflag_' || g, m - m0, sqrt(s2 * (1.0 / n + 1.0 / n0)) FROM gm, ref, q WHERE g <> 'A')
SELECT term, round(est, 6) AS estimate, round(est - q * se, 6) AS conf_low, round(est + q * se, 6) AS conf_high FROM e, q
""")
def ols_ci_one_factor(spark, d):
    """Coefficients with 95 % t intervals."""
    li, names = FE.dummy_columns(lm_frame(spark, d), "l_returnflag", ["A", "N", "R"])
    t = ols.fit_ols(li, "y", names).coef_table(spark)
    return t.select("term", *[F.round(c, 6).alias(c) for c in ("estimate", "conf_low", "conf_high")])


@register("model_roundtrip", """
SELECT l_orderkey, l_linenumber, round(avg(CAST(l_quantity > 25 AS INTEGER)) OVER (PARTITION BY l_linestatus), 6) AS prob FROM lineitem
""")
def model_roundtrip(spark, d):
    """A binomial fit saved by the first call, reloaded by the second, scores every row."""
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).cast("int").alias("y"), "l_linestatus")
    li, names = FE.dummy_columns(li, "l_linestatus", FE.factor_levels(li, "l_linestatus"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"

    def fit():
        return glm.fit_glm(li, "y", names, "binomial", pearson=False)

    io.fit_or_load(path, fit)
    loaded = io.fit_or_load(path, fit)
    io.delete_path(spark, path)
    return glm.predict(loaded, li, names, "prob").select("l_orderkey", "l_linenumber", F.round("prob", 6).alias("prob"))


@register("csv_export_roundtrip", """
SELECT o_custkey AS custkey, min(o_orderdate) AS first_day, count(*) AS n, max(o_orderpriority) AS priority, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM orders GROUP BY o_custkey
""")
def csv_export_roundtrip(spark, d):
    """Per-customer totals written as CSV with a header and read back with types."""
    o = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(
        F.min("o_orderdate").alias("first_day"), F.count(F.lit(1)).alias("n"), F.max("o_orderpriority").alias("priority"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    path = io.export_csv(o, f"{checkpoint_dir(spark).rstrip('/')}/export-{uuid.uuid4().hex}")
    return spark.read.schema(o.schema).option("header", True).csv(path)


@register("fitted_extract", """
WITH d AS (SELECT l_orderkey, l_linenumber, ln(l_extendedprice) AS y, l_returnflag AS g FROM lineitem)
SELECT l_orderkey, l_linenumber, round(y, 6) AS observed, round(avg(y) OVER (PARTITION BY g), 6) AS fitted,
       round(y - avg(y) OVER (PARTITION BY g), 6) AS residual FROM d
""")
def fitted_extract(spark, d):
    """Observed, fitted and residual per row of a one-factor linear model."""
    li, names = FE.dummy_columns(lm_frame(spark, d), "l_returnflag", ["A", "N", "R"])
    fitted = ols.fit_ols(li, "y", names).predict()
    return li.select("l_orderkey", "l_linenumber", F.round("y", 6).alias("observed"), F.round(fitted, 6).alias("fitted"),
                     F.round(F.col("y") - fitted, 6).alias("residual"))
