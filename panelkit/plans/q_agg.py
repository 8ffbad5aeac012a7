"""Registered queries: aggregates, profiles, coverage (AG1-AG23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit import constants as K
from panelkit.operators import aggregate as A
from panelkit.operators import panel as P
from panelkit.operators import reshape
from panelkit.plans.registry import register
from panelkit.sources import tables as T

_O_NULL = "(SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_totalprice <= 400000 THEN o_totalprice END AS amount FROM orders)"
_E_NULL = "(SELECT event_id, user_id, event_type, ts, CAST(ts AS DATE) AS date, props, " \
          "CASE WHEN value <= 100 THEN value END AS value FROM events)"
_W_SQL = """(SELECT s.s_nationkey AS region, CAST(l.l_shipdate AS DATE) AS date,
        avg(l.l_extendedprice) AS price_avg, avg(l.l_discount) AS discount_avg
      FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2)"""


@register("annual_sums", f"""
SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n_orders,
       round(COALESCE(sum(amount), 0.0), 2) AS amount,
       count(amount) AS n_with_amount
FROM {_O_NULL} GROUP BY 1, 2
""")
def annual_sums(spark, d):
    o = T.table(spark, d, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("year"),
        F.when(F.col("o_totalprice") <= 400000, F.col("o_totalprice")).alias("amount"))
    s = A.group_sums(o, ["o_custkey", "year"], ["amount"], count_name="n_orders", present="n_with_{col}")
    return s.select("o_custkey", "year", "n_orders", F.round("amount", 2).alias("amount"), "n_with_amount")


@register("annualise", """
WITH m AS (SELECT l_suppkey, year(l_shipdate) AS y, month(l_shipdate) AS mo, sum(l_quantity) AS q
           FROM lineitem GROUP BY 1, 2, 3),
y AS (SELECT l_suppkey, CAST(y AS INTEGER) AS year, count(*) AS months_available,
             COALESCE(sum(q), 0.0) AS total FROM m GROUP BY 1, 2)
SELECT l_suppkey, year, months_available, round(total, 4) AS total,
       round(total * 12 / months_available, 6) AS annual_total
FROM y WHERE months_available >= 10 AND total > 0
""")
def annualise(spark, d):
    li = T.lineitem_panel(spark, d)
    a = P.annualise(li, "l_suppkey", "date", "l_quantity", min_months=10)
    return a.select("l_suppkey", "year", "months_available", F.round("total", 4).alias("total"),
                    F.round("annual_total", 6).alias("annual_total"))


@register("weather_annual", f"""
SELECT region, CAST(year(date) AS INTEGER) AS year, round(avg(price_avg), 6) AS price_avg,
       round(avg(discount_avg), 8) AS discount_avg, count(*) AS n_days
FROM {_W_SQL} GROUP BY 1, 2
""")
def weather_annual(spark, d):
    w = T.region_day_covariates(spark, d)
    return w.groupBy("region", F.year("date").alias("year")).agg(
        F.round(F.avg("price_avg"), 6).alias("price_avg"),
        F.round(F.avg("discount_avg"), 8).alias("discount_avg"), F.count(F.lit(1)).alias("n_days"))


@register("avg_of_annual", f"""
WITH y AS (SELECT region, year(date) AS year, avg(price_avg) AS p FROM {_W_SQL} GROUP BY 1, 2)
SELECT region, round(avg(p), 6) AS price_avg_of_years, count(*) AS n_years FROM y GROUP BY 1
""")
def avg_of_annual(spark, d):
    w = T.region_day_covariates(spark, d)
    y = w.groupBy("region", F.year("date").alias("year")).agg(F.avg("price_avg").alias("p"))
    return y.groupBy("region").agg(F.round(F.avg("p"), 6).alias("price_avg_of_years"),
                                   F.count(F.lit(1)).alias("n_years"))


@register("across_stats", """
SELECT l_returnflag,
  round(avg(l_quantity), 6) AS l_quantity_mean, min(l_quantity) AS l_quantity_min,
  max(l_quantity) AS l_quantity_max, round(stddev_samp(l_quantity), 6) AS l_quantity_sd,
  round(avg(l_extendedprice), 4) AS l_extendedprice_mean, min(l_extendedprice) AS l_extendedprice_min,
  max(l_extendedprice) AS l_extendedprice_max, round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_sd,
  round(avg(l_discount), 8) AS l_discount_mean, min(l_discount) AS l_discount_min,
  max(l_discount) AS l_discount_max, round(stddev_samp(l_discount), 8) AS l_discount_sd
FROM lineitem GROUP BY 1
""")
def across_stats(spark, d):
    li = T.table(spark, d, "lineitem")
    a = A.across(li, ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount"],
                 ["mean", "min", "max", "sd"])
    digits = {"l_quantity": 6, "l_extendedprice": 4, "l_discount": 8}
    cols = ["l_returnflag"]
    for c, dg in digits.items():
        cols += [F.round(f"{c}_mean", dg).alias(f"{c}_mean"), f"{c}_min", f"{c}_max",
                 F.round(f"{c}_sd", dg).alias(f"{c}_sd")]
    return a.select(*cols)


_SUMMARY_VARS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("summary_stats", " UNION ALL ".join(f"""
SELECT '{v}' AS variable, count({v}) AS n, min({v}) AS min, round(quantile_cont({v}, 0.25), 6) AS q1,
       round(quantile_cont({v}, 0.5), 6) AS median, round(avg({v}), 6) AS mean,
       round(quantile_cont({v}, 0.75), 6) AS q3, max({v}) AS max, round(stddev_samp({v}), 6) AS sd
FROM lineitem""" for v in _SUMMARY_VARS))
def summary_stats(spark, d):
    li = T.table(spark, d, "lineitem")
    s = A.summary_stats(li, _SUMMARY_VARS)
    return s.select("variable", "n", "min", F.round("q1", 6).alias("q1"),
                    F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"),
                    F.round("q3", 6).alias("q3"), "max", F.round("sd", 6).alias("sd"))


@register("entities_per_day", """
SELECT CAST(ts AS DATE) AS date, count(DISTINCT user_id) AS n_entities, count(*) AS n_rows
FROM events GROUP BY 1
""")
def entities_per_day(spark, d):
    e = T.events_panel(spark, d)
    return A.n_distinct(e, "user_id", ["date"], name="n_entities", rows="n_rows").select("date", "n_entities", "n_rows")


@register("freq_pct", """
SELECT l_returnflag, l_linestatus, count(*) AS n,
       round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct
FROM lineitem GROUP BY 1, 2
""")
def freq_pct(spark, d):
    return A.freq_pct(T.table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


_NA_COLS = ["event_id", "user_id", "event_type", "ts", "value", "props"]


@register("na_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS n_missing,
       round_even(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 2) AS pct_missing
FROM {_E_NULL} e""" for c in _NA_COLS))
def na_profile(spark, d):
    e = T.events_with_nulls(spark, d).select(*_NA_COLS)
    return A.na_profile(e)


@register("missingness_pattern", f"""
WITH per AS (SELECT user_id, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS p
             FROM {_E_NULL} e GROUP BY 1)
SELECT CASE WHEN p = 100 THEN '{K.MISSING_ALWAYS}' WHEN p = 0 THEN '{K.MISSING_NEVER}'
            ELSE '{K.MISSING_PARTLY}' END AS category,
       count(*) AS n_entities, round_even(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct
FROM per GROUP BY 1
""")
def missingness_pattern(spark, d):
    e = T.events_with_nulls(spark, d)
    return A.missingness_pattern(e, "user_id", "value",
                                 (K.MISSING_ALWAYS, K.MISSING_NEVER, K.MISSING_PARTLY))


_RULES_SQL = [("quantity_above_45", "l_quantity > 45", "l_quantity"),
              ("discount_above_9pct", "l_discount > 0.09", "l_discount"),
              ("zero_tax", "l_tax = 0", "l_tax"),
              ("price_above_90000", "l_extendedprice > 90000", "l_extendedprice")]


@register("plausibility", " UNION ALL ".join(f"""
SELECT '{n}' AS rule, count(*) FILTER (WHERE {c} IS NOT NULL AND {p}) AS n_flagged,
       count({c}) AS n_checked,
       round_even(count(*) FILTER (WHERE {c} IS NOT NULL AND {p}) * 100.0 / count({c}), 2) AS pct_flagged
FROM lineitem""" for n, p, c in _RULES_SQL))
def plausibility(spark, d):
    li = T.table(spark, d, "lineitem")
    rules = {
        "quantity_above_45": (F.col("l_quantity") > 45, "l_quantity"),
        "discount_above_9pct": (F.col("l_discount") > 0.09, "l_discount"),
        "zero_tax": (F.col("l_tax") == 0, "l_tax"),
        "price_above_90000": (F.col("l_extendedprice") > 90000, "l_extendedprice"),
    }
    return A.rule_table(li, rules)


@register("dup_keys", """
SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1
""")
def dup_keys(spark, d):
    return A.dup_keys(T.events_panel(spark, d).select("user_id", "date"), ["user_id", "date"])


@register("dataset_overview", """
SELECT count(*) AS n_rows, 12 AS n_columns, count(DISTINCT l_suppkey) AS n_entities,
       min(CAST(l_shipdate AS DATE)) AS first_date, max(CAST(l_shipdate AS DATE)) AS last_date,
       CAST(date_diff('day', min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE))) + 1 AS INTEGER)
         AS span_days
FROM lineitem
""")
def dataset_overview(spark, d):
    out = A.dataset_overview(T.lineitem_panel(spark, d), "l_suppkey", "date")
    return out


@register("coverage", """
WITH w AS (SELECT min(CAST(ts AS DATE)) AS d0, max(CAST(ts AS DATE)) AS d1 FROM events),
days AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY 1)
SELECT user_id, n_days, CAST(date_diff('day', w.d0, w.d1) + 1 AS INTEGER) AS days_in_window,
       round(n_days * 100.0 / (date_diff('day', w.d0, w.d1) + 1), 6) AS coverage_pct
FROM days, w
""")
def coverage(spark, d):
    c = P.coverage(T.events_panel(spark, d), "user_id", "date")
    return c.select("user_id", "n_days", "days_in_window", F.round("coverage_pct", 6).alias("coverage_pct"))


@register("coverage_matrix", """
WITH w AS (SELECT min(CAST(ts AS DATE)) AS d0, max(CAST(ts AS DATE)) AS d1 FROM events),
full_ AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) * 100.0 / (date_diff('day', w.d0, w.d1) + 1) AS cov,
                 date_diff('day', w.d0, w.d1) + 1 AS days
          FROM events, w GROUP BY user_id, w.d0, w.d1),
late AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) * 100.0 / (date_diff('day', DATE '2024-01-15', w.d1) + 1) AS cov,
                date_diff('day', DATE '2024-01-15', w.d1) + 1 AS days
         FROM events, w WHERE CAST(ts AS DATE) >= DATE '2024-01-15' GROUP BY user_id, w.d1),
t(threshold_pct) AS (VALUES (99.5), (95.0), (90.0))
SELECT 'full' AS "window", CAST(max(days) AS INTEGER) AS days_in_window, count(*) AS n_entities,
       CAST(t.threshold_pct AS DOUBLE) AS threshold_pct, count(*) FILTER (WHERE cov >= t.threshold_pct) AS n_reaching
FROM full_, t GROUP BY t.threshold_pct
UNION ALL
SELECT 'from_2024_01_15', CAST(max(days) AS INTEGER), count(*), CAST(t.threshold_pct AS DOUBLE),
       count(*) FILTER (WHERE cov >= t.threshold_pct)
FROM late, t GROUP BY t.threshold_pct
""")
def coverage_matrix(spark, d):
    e = T.events_panel(spark, d)
    return P.coverage_matrix(e, "user_id", "date", {"full": (None, None),
                                                    "from_2024_01_15": ("2024-01-15", None)},
                             K.COVERAGE_THRESHOLDS)


@register("eligible", """
SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n_days, 30 AS days_in_window,
       round(count(DISTINCT CAST(ts AS DATE)) * 100.0 / 30, 6) AS coverage_pct
FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'
GROUP BY 1 HAVING count(DISTINCT CAST(ts AS DATE)) * 100.0 / 30 >= 90
""")
def eligible(spark, d):
    el = P.eligible(T.events_panel(spark, d), "user_id", "date", "2024-01-01", "2024-01-30", 90.0)
    return el.select("user_id", "n_days", "days_in_window", F.round("coverage_pct", 6).alias("coverage_pct"))


@register("monthly_counts", """
SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS year_month,
       CAST(sum(CAST(l_quantity > 25 AS INTEGER)) AS INTEGER) AS n_high_days, count(*) AS n_days,
       round(avg(l_discount), 8) AS discount_avg, round(avg(l_tax), 8) AS tax_avg,
       round(avg(CAST(isodow(l_shipdate) >= 6 AS DOUBLE)), 8) AS share_weekend,
       arg_min(l_returnflag, (l_shipdate, l_orderkey, l_linenumber)) AS first_flag,
       round(ln(count(*)), 8) AS log_n_days
FROM lineitem GROUP BY 1, 2
""")
def monthly_counts(spark, d):
    li = T.lineitem_panel(spark, d)
    m = P.monthly_rollup(
        li, "l_suppkey", "date", (F.col("l_quantity") > 25).cast("int"),
        {"discount_avg": F.col("l_discount"), "tax_avg": F.col("l_tax"),
         "share_weekend": (F.weekday("date") >= 5).cast("double")},
        firsts={"first_flag": "l_returnflag"},
        first_order=F.struct("date", "l_orderkey", "l_linenumber"))
    return m.select("l_suppkey", "year_month", "n_high_days", "n_days",
                    *[F.round(c, 8).alias(c) for c in ("discount_avg", "tax_avg", "share_weekend",
                                                        "log_n_days")], "first_flag")


@register("zero_share", """
SELECT 'share' AS kind, CAST(NULL AS DOUBLE) AS l_tax, round(avg(CAST(l_tax = 0 AS DOUBLE)), 8) AS value FROM lineitem
UNION ALL
SELECT 'count', l_tax, CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY l_tax
""")
def zero_share(spark, d):
    li = T.table(spark, d, "lineitem")
    share = A.zero_share(li, "l_tax").select(F.lit("share").alias("kind"),
                                             F.lit(None).cast("double").alias("l_tax"),
                                             F.round("share_zero", 8).alias("value"))
    counts = li.groupBy("l_tax").agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit("count").alias("kind"), "l_tax", "value")
    return reshape.union_by_name(share, counts)


_CORR_VARS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_L_NULL = ("(SELECT l_quantity, l_extendedprice, CASE WHEN l_quantity <= 45 THEN l_discount END AS l_discount,"
           " l_tax FROM lineitem)")


@register("corr_matrix", " UNION ALL ".join(f"""
SELECT '{a}' AS var1, '{b}' AS var2, round(corr({a}, {b}), 6) AS r,
       count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n_pairs FROM {_L_NULL} x"""
                                            for a in _CORR_VARS for b in _CORR_VARS))
def corr_matrix(spark, d):
    li = T.table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice",
        F.when(F.col("l_quantity") <= 45, F.col("l_discount")).alias("l_discount"), "l_tax")
    return A.corr_matrix(li, _CORR_VARS)


@register("contingency", """
WITH a AS (SELECT DISTINCT l_returnflag FROM lineitem), b AS (SELECT DISTINCT l_linestatus FROM lineitem),
c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.l_returnflag, b.l_linestatus, COALESCE(c.n, 0) AS n
FROM a CROSS JOIN b LEFT JOIN c ON c.l_returnflag = a.l_returnflag AND c.l_linestatus = b.l_linestatus
""")
def contingency(spark, d):
    return A.contingency(T.table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@register("step_audit", """
WITH full_ AS (SELECT user_id, CAST(ts AS DATE) AS date FROM events),
win AS (SELECT * FROM full_ WHERE date BETWEEN DATE '2024-01-08' AND DATE '2024-01-30'),
cov AS (SELECT user_id, count(DISTINCT date) * 100.0 / 23 AS p FROM win GROUP BY 1),
el AS (SELECT user_id FROM cov WHERE p >= 80),
fin AS (SELECT * FROM win WHERE user_id IN (SELECT user_id FROM el))
SELECT 0 AS step, 'full panel' AS label, count(DISTINCT user_id) AS n_entities, count(*) AS n_rows FROM full_
UNION ALL SELECT 1, 'time window', count(DISTINCT user_id), count(*) FROM win
UNION ALL SELECT 2, 'eligible (>=80% coverage)', count(*), CAST(NULL AS BIGINT) FROM el
UNION ALL SELECT 3, 'final subset', count(DISTINCT user_id), count(*) FROM fin
""")
def step_audit(spark, d):
    e = T.events_panel(spark, d).select("user_id", "date")
    return P.filtration_audit(e, "user_id", "date", "2024-01-08", "2024-01-30", 80.0,
                              ["full panel", "time window", "eligible (>=80% coverage)", "final subset"])


@register("column_profile", " UNION ALL ".join(f"""
SELECT '{c}' AS variable, '{t}' AS type, '{r}' AS role, count(DISTINCT {c}) AS n_distinct FROM orders"""
                                               for c, t, r in (("o_orderkey", "bigint", "numeric"),
                                                               ("o_custkey", "bigint", "numeric"),
                                                               ("o_orderstatus", "string", "categorical"),
                                                               ("o_totalprice", "double", "numeric"),
                                                               ("o_orderdate", "timestamp_ntz", "date"),
                                                               ("o_orderpriority", "string", "categorical"))))
def column_profile(spark, d):
    return A.column_profile(T.table(spark, d, "orders"))
