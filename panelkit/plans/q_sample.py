"""Registered queries: sampling, splits, ordering, ROC/AUC, features, chart
data and the flagship modelling-subset chain (SP*, WN*, FE*, CH*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.models import evaluate as EV
from panelkit.operators import charts, features as FE, joins, panel as P, sampling as SP
from panelkit.plans.registry import register
from panelkit.sources import tables as T


def _md5(*cols, seed="42"):
    inner = ", ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    return f"md5(concat_ws('#', {inner}, '{seed}'))"


def _h32(*cols, seed="42"):
    return f"CAST(('0x' || substr({_md5(*cols, seed=seed)}, 1, 8)) AS BIGINT)"


# ---------------------------------------------------------------- flagship chain

MODEL_WINDOW = ("2024-01-01", "2024-01-30")
MODEL_MIN_COVERAGE = 80.0
MODEL_ROW_BUDGET = 5000


@register("model_subset", f"""
WITH win AS (SELECT event_id, user_id, CAST(ts AS DATE) AS date, value FROM events
             WHERE CAST(ts AS DATE) BETWEEN DATE '{MODEL_WINDOW[0]}' AND DATE '{MODEL_WINDOW[1]}'),
cov AS (SELECT user_id, count(DISTINCT date) AS n_days, count(*) AS n_rows FROM win GROUP BY 1),
el AS (SELECT * FROM cov WHERE n_days * 100.0 / 30 >= {MODEL_MIN_COVERAGE}),
adm AS (SELECT user_id FROM (
          SELECT user_id, sum(n_rows) OVER (ORDER BY {_md5('user_id')}, user_id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum
          FROM el) WHERE cum <= {MODEL_ROW_BUDGET}),
sub AS (SELECT * FROM win WHERE user_id IN (SELECT user_id FROM adm)),
m AS (SELECT median(value) AS med FROM sub)
SELECT event_id, user_id, date, value, CAST(value > m.med AS INTEGER) AS high_consumption,
       round(CASE WHEN value > 0 THEN ln(value) END, 8) AS log_value
FROM sub, m
""")
def model_subset(spark, d):
    """Window -> coverage -> eligible -> row-budget sample -> labelled rows."""
    e = T.events_panel(spark, d).select("event_id", "user_id", "date", "value")
    win = P.window_filter(e, "date", *MODEL_WINDOW)
    el = P.eligible(win, "user_id", "date", *MODEL_WINDOW, MODEL_MIN_COVERAGE)
    admitted = SP.budget_admit(el, "user_id", "n_rows", MODEL_ROW_BUDGET, seed=42)
    sub = joins.member_of(win, admitted, "user_id")
    out = FE.responses(sub, "value", "high_consumption", "log_value")
    return out.select("event_id", "user_id", "date", "value", "high_consumption",
                      F.round("log_value", 8).alias("log_value"))


# ---------------------------------------------------------------- sampling

@register("budget_sample", f"""
WITH u AS (SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1),
c AS (SELECT user_id, n_rows, CAST(sum(n_rows) OVER (ORDER BY {_md5('user_id')}, user_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_rows FROM u)
SELECT * FROM c WHERE cumulative_rows <= 4000
""")
def budget_sample(spark, d):
    u = T.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return SP.budget_admit(u, "user_id", "n_rows", 4000, seed=42)


@register("budget_top", """
WITH u AS (SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1),
c AS (SELECT user_id, n_rows, sum(n_rows) OVER (ORDER BY n_rows DESC, user_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM u)
SELECT count(*) AS n_entities, CAST(sum(n_rows) AS BIGINT) AS n_rows, round(avg(n_rows), 6) AS mean_size
FROM c WHERE cum <= 4000
""")
def budget_top(spark, d):
    u = T.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
    adm = SP.budget_admit(u, "user_id", "n_rows", 4000, order="largest")
    s = SP.prefix_summary(adm, "n_rows")
    return s.withColumn("mean_size", F.round("mean_size", 6))


@register("panel_sample", f"""
WITH u AS (SELECT user_id, count(*) AS n_rows FROM events GROUP BY 1),
c AS (SELECT user_id, sum(n_rows) OVER (ORDER BY {_md5('user_id')}, user_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM u)
SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM c WHERE cum <= 4000)
""")
def panel_sample(spark, d):
    e = T.table(spark, d, "events")
    u = e.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))
    adm = SP.budget_admit(u, "user_id", "n_rows", 4000, seed=42)
    return joins.member_of(e.select("event_id", "user_id"), adm, "user_id")


@register("sample_n", f"""
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
ORDER BY {_md5('l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber LIMIT 480
""")
def sample_n(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return SP.sample_n(li, ["l_orderkey", "l_linenumber"], 480, seed=42)


@register("split_exact", f"""
WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_md5('o_orderkey')}, o_orderkey) AS rk,
                  count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CAST(rk <= floor(n * 0.8) AS INTEGER) AS is_train FROM r
""")
def split_exact(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey")
    return SP.split_exact(o, ["o_orderkey"], 0.8, seed=42)


@register("split_stratified", f"""
WITH r AS (SELECT o_orderkey, o_orderstatus,
                  row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_md5('o_orderkey')}, o_orderkey) AS rk,
                  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CAST(rk <= ceil(n * 0.8) AS INTEGER) AS is_train FROM r
""")
def split_stratified(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return SP.split_exact(o, ["o_orderkey"], 0.8, seed=42, by=["o_orderstatus"], rounding="ceil")


@register("kfold", f"""
SELECT o_orderkey, CAST({_h32('o_orderkey')} % 5 AS INTEGER) AS fold FROM orders
""")
def kfold(spark, d):
    return SP.kfold(T.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 5, seed=42)


# ---------------------------------------------------------------- ordering / evaluation

_ROC_SQL = """
WITH per AS (SELECT l_discount AS threshold, sum(CAST(l_quantity > 25 AS BIGINT)) AS pos,
                    sum(CAST(l_quantity <= 25 AS BIGINT)) AS neg FROM lineitem GROUP BY 1),
c AS (SELECT threshold, pos, neg,
             sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM per)
"""


@register("roc_curve", _ROC_SQL + """
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       round(tp / P, 8) AS tpr, round(fp / N, 8) AS fpr FROM c
""")
def roc_curve(spark, d):
    li = T.table(spark, d, "lineitem").select(
        "l_discount", (F.col("l_quantity") > 25).cast("int").alias("label"))
    pts = EV.roc_points(li, "label", "l_discount")
    return pts.select("threshold", "tp", "fp", F.round("tpr", 8).alias("tpr"),
                      F.round("fpr", 8).alias("fpr"))


@register("auc", _ROC_SQL + """
SELECT round(sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)), 10) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c
""")
def auc(spark, d):
    li = T.table(spark, d, "lineitem").select(
        "l_discount", (F.col("l_quantity") > 25).cast("int").alias("label"))
    a = EV.auc(li, "label", "l_discount")
    return a.withColumn("auc", F.round("auc", 10))


@register("sorted_profile", """
SELECT l_linenumber, round(avg(l_quantity), 6) AS avg_quantity,
       CAST(rank() OVER (ORDER BY avg(l_quantity) DESC, l_linenumber) AS INTEGER) AS rank
FROM lineitem GROUP BY 1
""")
def sorted_profile(spark, d):
    from pyspark.sql import Window
    li = T.table(spark, d, "lineitem")
    g = li.groupBy("l_linenumber").agg(F.avg("l_quantity").alias("_a"))
    # one row per category: the ordering window runs on the aggregated table
    w = Window.orderBy(F.col("_a").desc(), "l_linenumber")
    return g.select("l_linenumber", F.round("_a", 6).alias("avg_quantity"),
                    F.rank().over(w).cast("int").alias("rank"))


@register("slice_extremes", r"""
WITH t AS (SELECT l_returnflag || '_' || l_linestatus AS term, avg(l_discount) AS v FROM lineitem GROUP BY 1
           UNION ALL SELECT '(Intercept)', avg(l_discount) FROM lineitem),
f AS (SELECT * FROM t WHERE NOT regexp_matches(term, '^\(Intercept\)$'))
SELECT * FROM (SELECT 'max' AS which, term, round(v, 8) AS value FROM f ORDER BY v DESC, term LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'min', term, round(v, 8) FROM f ORDER BY v ASC, term LIMIT 1)
""")
def slice_extremes(spark, d):
    li = T.table(spark, d, "lineitem")
    t = (li.groupBy(F.concat_ws("_", "l_returnflag", "l_linestatus").alias("term"))
         .agg(F.avg("l_discount").alias("v"))
         .unionByName(li.agg(F.lit("(Intercept)").alias("term"), F.avg("l_discount").alias("v"))))
    f = t.where(~F.col("term").rlike(r"^\(Intercept\)$"))
    top = f.orderBy(F.col("v").desc(), "term").limit(1).select(F.lit("max").alias("which"), "term", "v")
    bot = f.orderBy(F.col("v").asc(), "term").limit(1).select(F.lit("min").alias("which"), "term", "v")
    return top.unionByName(bot).select("which", "term", F.round("v", 8).alias("value"))


# ---------------------------------------------------------------- features

@register("dummy_matrix", """
SELECT l_orderkey, l_linenumber,
       CAST(l_returnflag = 'N' AS INTEGER) AS l_returnflag_N, CAST(l_returnflag = 'R' AS INTEGER) AS l_returnflag_R,
       CAST(l_linestatus = 'O' AS INTEGER) AS l_linestatus_O
FROM lineitem
""")
def dummy_matrix(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    out, n1 = FE.dummy_columns(li, "l_returnflag", FE.factor_levels(li, "l_returnflag"))
    out, n2 = FE.dummy_columns(out, "l_linestatus", FE.factor_levels(li, "l_linestatus"))
    return out.select("l_orderkey", "l_linenumber", *n1, *n2)


@register("zscore_train", f"""
WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_discount) AS md,
                  stddev_samp(l_discount) AS sd FROM lineitem
           WHERE {_h32('l_orderkey', 'l_linenumber')} < 3435973836)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / sq, 8) AS l_quantity_z,
       round((l_discount - md) / sd, 8) AS l_discount_z FROM lineitem, s
""")
def zscore_train(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    li = SP.split_hash(li, ["l_orderkey", "l_linenumber"], 0.8, seed=42)
    cols = ["l_quantity", "l_discount"]
    z = FE.standardise(li, cols, FE.train_stats(li, cols, "is_train"), suffix="_z")
    return z.select("l_orderkey", "l_linenumber", *[F.round(f"{c}_z", 8).alias(f"{c}_z") for c in cols])


@register("interaction_cols", """
SELECT l_orderkey, l_linenumber,
       l_quantity * CAST(l_returnflag = 'N' AS INTEGER) AS l_quantity_x_l_returnflag_N,
       l_quantity * CAST(l_returnflag = 'R' AS INTEGER) AS l_quantity_x_l_returnflag_R
FROM lineitem
""")
def interaction_cols(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    out, dn = FE.dummy_columns(li, "l_returnflag", FE.factor_levels(li, "l_returnflag"))
    out, names = FE.interaction_columns(out, "l_quantity", dn)
    return out.select("l_orderkey", "l_linenumber", *names)


@register("label_by_quantile", """
WITH q AS (SELECT quantile_cont(l_extendedprice, 0.75) AS t FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(l_extendedprice >= q.t AS INTEGER) AS top_quartile FROM lineitem, q
""")
def label_by_quantile(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return FE.label_by_quantile(li, "l_extendedprice", 0.75, "top_quartile", ">=").drop("l_extendedprice")


@register("label_own_median", """
WITH m AS (SELECT l_suppkey, median(l_quantity) AS med FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, CAST(l_quantity > m.med AS INTEGER) AS above_own_median
FROM lineitem JOIN m USING (l_suppkey)
""")
def label_own_median(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    out = FE.label_above_median(li, "l_quantity", "above_own_median", by=["l_suppkey"])
    return out.select("l_orderkey", "l_linenumber", "above_own_median")


# ---------------------------------------------------------------- chart data

@register("histogram", """
WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT l_linestatus, CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, hi
      FROM lineitem, r)
SELECT l_linestatus, bin, round(lo + bin * ((hi - lo) / 20), 6) AS bin_lo,
       round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS bin_hi, count(*) AS n
FROM b GROUP BY l_linestatus, bin, lo, hi
""")
def histogram(spark, d):
    li = T.table(spark, d, "lineitem").select("l_linestatus", "l_extendedprice")
    h = charts.histogram(li, "l_extendedprice", 20, ["l_linestatus"])
    return h.select("l_linestatus", "bin", F.round("bin_lo", 6).alias("bin_lo"),
                    F.round("bin_hi", 6).alias("bin_hi"), "n")


@register("box_stats", """
WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
                  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT f.l_returnflag, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(lf, 6) AS lower_fence, round(uf, 6) AS upper_fence, count(*) AS n,
       min(CASE WHEN l_extendedprice BETWEEN lf AND uf THEN l_extendedprice END) AS whisker_lo,
       max(CASE WHEN l_extendedprice BETWEEN lf AND uf THEN l_extendedprice END) AS whisker_hi,
       count(*) FILTER (WHERE NOT (l_extendedprice BETWEEN lf AND uf)) AS n_outliers
FROM lineitem l JOIN f USING (l_returnflag)
GROUP BY f.l_returnflag, q1, median, q3, iqr, lf, uf
""")
def box_stats(spark, d):
    li = T.table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    b = charts.box_stats(li, "l_extendedprice", ["l_returnflag"])
    return b.select("l_returnflag", *[F.round(c, 6).alias(c) for c in
                                      ("q1", "median", "q3", "iqr", "lower_fence", "upper_fence")],
                    "n", "whisker_lo", "whisker_hi", "n_outliers")


@register("flag_by_month", """
SELECT CAST(month(l_shipdate) AS INTEGER) AS month, strftime(l_shipdate, '%b') AS month_label,
       round(avg(CAST(l_quantity > 25 AS DOUBLE)) * 100, 6) AS pct_flagged, count(*) AS n
FROM lineitem GROUP BY 1, 2
""")
def flag_by_month(spark, d):
    li = T.lineitem_panel(spark, d).select(
        F.month("date").alias("month"), F.date_format("date", "MMM").alias("month_label"),
        (F.col("l_quantity") > 25).cast("int").alias("flag"))
    out = charts.flag_share_by(li, "flag", ["month", "month_label"])
    return out.withColumn("pct_flagged", F.round("pct_flagged", 6))


@register("binary_share", """
WITH f AS (SELECT o_custkey, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS prio,
                  arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY 1)
SELECT 'is_urgent' AS attribute, round(avg(CAST(prio = '1-URGENT' AS DOUBLE)) * 100, 6) AS pct, count(*) AS n_entities FROM f
UNION ALL SELECT 'is_finished', round(avg(CAST(status = 'F' AS DOUBLE)) * 100, 6), count(*) FROM f
""")
def binary_share(spark, d):
    o = T.table(spark, d, "orders").select(
        "o_custkey", "o_orderdate", "o_orderkey",
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("is_urgent"),
        (F.col("o_orderstatus") == "F").cast("int").alias("is_finished"))
    s = charts.binary_share(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["is_urgent", "is_finished"])
    return s.select("attribute", F.round("pct", 6).alias("pct"), "n_entities")
