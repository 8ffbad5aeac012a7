"""Registered queries over NULL keys and values, and over the sources, sinks and
reshaping operators, each against its own SQL.

The driver tables hold no NULLs, so both sides inject the same ones: a group
key is NULL where its row number in the table's key is a multiple of seven, a
value where it is a multiple of eleven.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.models import evaluate as EV, ols
from panelkit.operators import aggregate as A, charts, features as FE, prep, reshape, sampling as SP
from panelkit.plans.registry import register
from panelkit.sources import io, tables as T

_L = """l AS (SELECT l_orderkey, l_linenumber, CASE WHEN (l_orderkey + l_linenumber) % 7 <> 0 THEN l_returnflag END AS flag,
       CASE WHEN l_orderkey % 7 <> 0 THEN l_suppkey END AS suppkey, l_linestatus,
       CASE WHEN (l_orderkey + l_linenumber) % 11 <> 0 THEN l_quantity END AS quantity, l_extendedprice, l_discount FROM lineitem)"""


def lineitem_with_nulls(spark, d):
    li = T.table(spark, d, "lineitem")
    n = F.col("l_orderkey") + F.col("l_linenumber")
    return li.select("l_orderkey", "l_linenumber", F.when(n % 7 != 0, F.col("l_returnflag")).alias("flag"),
                     F.when(F.col("l_orderkey") % 7 != 0, F.col("l_suppkey")).alias("suppkey"), "l_linestatus",
                     F.when(n % 11 != 0, F.col("l_quantity")).alias("quantity"), "l_extendedprice", "l_discount")


@register("split_stratified_null", """
WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status FROM orders),
r AS (SELECT o_orderkey, status, row_number() OVER (PARTITION BY status ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '#42'), o_orderkey) AS rk,
             count(*) OVER (PARTITION BY status) AS n FROM o)
SELECT o_orderkey, status, CAST(rk <= ceil(n * 0.8) AS INTEGER) AS is_train FROM r
""")
def split_stratified_null(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"))
    return SP.split_exact(o, ["o_orderkey"], 0.8, seed=42, by=["status"], rounding="ceil")


@register("box_stats_null", f"""
WITH {_L}, q AS (SELECT flag, quantile_cont(quantity, 0.25) AS q1, quantile_cont(quantity, 0.5) AS median, quantile_cont(quantity, 0.75) AS q3
                 FROM l WHERE quantity IS NOT NULL GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT f.flag, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, count(*) AS n,
       min(CASE WHEN quantity BETWEEN lf AND uf THEN quantity END) AS whisker_lo,
       max(CASE WHEN quantity BETWEEN lf AND uf THEN quantity END) AS whisker_hi,
       count(*) FILTER (WHERE NOT (quantity BETWEEN lf AND uf)) AS n_outliers
FROM l JOIN f ON l.flag IS NOT DISTINCT FROM f.flag WHERE quantity IS NOT NULL GROUP BY f.flag, q1, median, q3, lf, uf
""")
def box_stats_null(spark, d):
    b = charts.box_stats(lineitem_with_nulls(spark, d), "quantity", ["flag"])
    return b.select("flag", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "n", "whisker_lo", "whisker_hi", "n_outliers")


@register("contingency_null", f"""
WITH {_L}, a AS (SELECT DISTINCT flag FROM l), b AS (SELECT DISTINCT l_linestatus FROM l),
c AS (SELECT flag, l_linestatus, count(*) AS n FROM l GROUP BY 1, 2)
SELECT a.flag, b.l_linestatus, COALESCE(c.n, 0) AS n
FROM a CROSS JOIN b LEFT JOIN c ON c.flag IS NOT DISTINCT FROM a.flag AND c.l_linestatus = b.l_linestatus
""")
def contingency_null(spark, d):
    return A.contingency(lineitem_with_nulls(spark, d), "flag", "l_linestatus")


@register("summary_stats_null", f"WITH {_L} " + " UNION ALL ".join(f"""
SELECT flag, '{v}' AS variable, count({v}) AS n, min({v}) AS min, round(quantile_cont({v}, 0.25), 6) AS q1,
       round(quantile_cont({v}, 0.5), 6) AS median, round(avg({v}), 6) AS mean, round(quantile_cont({v}, 0.75), 6) AS q3,
       max({v}) AS max, round(stddev_samp({v}), 6) AS sd FROM l GROUP BY flag""" for v in ("quantity", "l_discount")))
def summary_stats_null(spark, d):
    s = A.summary_stats(lineitem_with_nulls(spark, d), ["quantity", "l_discount"], ["flag"])
    return s.select("flag", "variable", "n", "min", *[F.round(c, 6).alias(c) for c in ("q1", "median", "mean", "q3")], "max", F.round("sd", 6).alias("sd"))


@register("label_own_median_null", f"""
WITH {_L}, m AS (SELECT suppkey, median(quantity) AS med FROM l GROUP BY 1)
SELECT l_orderkey, l_linenumber, CAST(quantity > m.med AS INTEGER) AS above_own_median
FROM l LEFT JOIN m ON l.suppkey IS NOT DISTINCT FROM m.suppkey
""")
def label_own_median_null(spark, d):
    out = FE.label_above_median(lineitem_with_nulls(spark, d), "quantity", "above_own_median", by=["suppkey"])
    return out.select("l_orderkey", "l_linenumber", "above_own_median")


_PRED = f"""{_L}, p AS (SELECT quantity AS y, CASE WHEN l_orderkey % 5 <> 0 THEN l_discount * 200 + 15 END AS yhat FROM l)"""


@register("reg_metrics_null", f"""
WITH {_PRED}, c AS (SELECT * FROM p WHERE y IS NOT NULL AND yhat IS NOT NULL)
SELECT round(sqrt(avg((y - yhat) * (y - yhat))), 8) AS rmse, round(avg(abs(y - yhat)), 8) AS mae, count(*) AS n,
       round(1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)), 8) AS r2 FROM c
""")
def reg_metrics_null(spark, d):
    li = lineitem_with_nulls(spark, d).select(F.col("quantity").alias("y"),
                                              F.when(F.col("l_orderkey") % 5 != 0, F.col("l_discount") * 200 + 15).alias("yhat"))
    m = EV.reg_metrics(li, "y", "yhat")
    return m.select(F.round("rmse", 8).alias("rmse"), F.round("mae", 8).alias("mae"), "n", F.round("r2", 8).alias("r2"))


@register("auc_null", f"""
WITH {_L}, s AS (SELECT CAST(l_discount >= 0.05 AS INTEGER) AS label, quantity AS score FROM l WHERE quantity IS NOT NULL),
per AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM s GROUP BY 1),
c AS (SELECT pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp FROM per)
SELECT round(sum(neg * (tp - pos / 2.0)) / (sum(pos) * sum(neg)), 10) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos,
       CAST(sum(neg) AS BIGINT) AS n_neg, (SELECT count(*) FROM l WHERE quantity IS NULL) AS n_unscored FROM c
""")
def auc_null(spark, d):
    li = lineitem_with_nulls(spark, d).select((F.col("l_discount") >= 0.05).cast("int").alias("label"), "quantity")
    left = EV.unscored(li, "label", "quantity").select("n_unscored")
    return EV.auc(li, "label", "quantity").withColumn("auc", F.round("auc", 10)).crossJoin(F.broadcast(left))


@register("ols_sweep_factors", """
WITH d AS (SELECT ln(l_extendedprice) AS y, l_quantity, l_returnflag, l_linestatus FROM lineitem),
t AS (SELECT var_pop(y) * count(*) AS sst, avg(y) AS m, count(*) AS n FROM d),
g AS (SELECT 'l_returnflag' AS predictor, l_returnflag AS lv, avg(y) AS gm, count(*) AS gn FROM d GROUP BY 2
      UNION ALL SELECT 'l_linestatus', l_linestatus, avg(y), count(*) FROM d GROUP BY 2),
r AS (SELECT predictor, n, sum(gn * pow(gm - m, 2)) / sst AS r2, count(*) AS k FROM g, t GROUP BY predictor, n, sst
      UNION ALL SELECT 'l_quantity', count(*), regr_r2(y, l_quantity), 2 FROM d)
SELECT predictor, n, round(r2, 8) AS r2, round(1 - (1 - r2) * (n - 1) / (n - k), 8) AS adj_r2,
       round((r2 / (k - 1)) / ((1 - r2) / (n - k)), 4) AS f_stat, CAST(row_number() OVER (ORDER BY r2 DESC) AS INTEGER) AS rank FROM r
""")
def ols_sweep_factors(spark, d):
    li = T.table(spark, d, "lineitem").select(F.ln("l_extendedprice").alias("y"), "l_quantity", "l_returnflag", "l_linestatus")
    s = ols.univariate_sweep(li, "y", ["l_quantity"], ["l_returnflag", "l_linestatus"])
    return s.select("predictor", "n", F.round("r2", 8).alias("r2"), F.round("adj_r2", 8).alias("adj_r2"), F.round("f_stat", 4).alias("f_stat"), "rank")


@register("contract_pairs", """
SELECT 'at_most:n_high<=n_days' AS "check", CAST(0 AS BIGINT) AS n_violations
UNION ALL SELECT 'at_most:n_days<=n_high', count(*) FILTER (WHERE n_days > n_high) FROM (
    SELECT l_suppkey, sum(CAST(l_quantity > 25 AS BIGINT)) AS n_high, count(*) AS n_days FROM lineitem GROUP BY 1)
UNION ALL SELECT 'max_rows', CAST(0 AS BIGINT)
""")
def contract_pairs(spark, d):
    m = T.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_quantity") > 25).alias("n_high"), F.count(F.lit(1)).alias("n_days"))
    return prep.contract_violations(m, at_most=[("n_high", "n_days"), ("n_days", "n_high")])


@register("unpivot_measures", """
SELECT l_orderkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS value FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem
""")
def unpivot_measures(spark, d):
    return reshape.unpivot(T.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "value")


@register("pivot_stats", """
SELECT l_returnflag, max(CASE WHEN l_linestatus = 'F' THEN q END) AS F, max(CASE WHEN l_linestatus = 'O' THEN q END) AS O
FROM (SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2) GROUP BY 1
""")
def pivot_stats(spark, d):
    g = T.table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("q"))
    return reshape.pivot(g, ["l_returnflag"], "l_linestatus", "q", levels=["F", "O"], agg="first")


@register("union_metrics", """
SELECT 'orders' AS source, count(*) AS n, round(avg(o_totalprice), 4) AS mean_value, CAST(NULL AS BIGINT) AS n_lines FROM orders
UNION ALL SELECT 'lineitem', count(*), round(avg(l_extendedprice), 4), count(*) FROM lineitem
""")
def union_metrics(spark, d):
    o = T.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_value"))
    li = T.table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_value"))
    return reshape.union_by_name(o.withColumn("source", F.lit("orders")),
                               li.withColumn("source", F.lit("lineitem")).withColumn("n_lines", F.col("n"))).select("source", "n", "mean_value", "n_lines")


def _folder(spark, name: str) -> str:
    import uuid
    return io.table_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("read_delimited", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, c_name FROM customer
""")
def read_delimited(spark, d):
    """Customers as two delimited files with their columns in another order, read back by name."""
    c = T.table(spark, d, "customer").select(F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    at = _folder(spark, "raw files")
    odd = F.col("c_custkey").cast("long") % 2 == 1
    io.export_csv(c.where(odd).select("c_custkey", "c_name", "c_mktsegment"), f"{at}/a", sep=";")
    io.export_csv(c.where(~odd).select("c_mktsegment", "c_custkey", "c_name"), f"{at}/b", sep=";")
    return io.read_delimited_dir(spark, at, ["c_custkey", "c_mktsegment", "c_name"], key_columns=["c_custkey"])


@register("read_dimension", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def read_dimension(spark, d):
    at = io.export_csv(T.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), _folder(spark, "nation"), sep=";", single_file=True)
    return io.read_dimension(spark, at, "n_nationkey int, n_name string, n_regionkey int")


@register("rename_positions", """
SELECT s_suppkey AS supplier, s_name AS s_name, s_nationkey AS "nation.key", s_acctbal AS s_acctbal FROM supplier
""")
def rename_positions(spark, d):
    s = T.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    by_name = prep.rename(s, {"s_nationkey": "nation key"}, make_safe=True)
    return prep.rename(by_name, ["supplier", *by_name.columns[1:]])
