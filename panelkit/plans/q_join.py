"""Registered queries: joins (JN1-JN9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit.operators import joins, sampling
from panelkit.operators.quantile import quantiles_wide
from panelkit.plans.registry import register
from panelkit.sources import tables as T

_W_SQL = """(SELECT s.s_nationkey AS region, CAST(l.l_shipdate AS DATE) AS date,
        avg(l.l_extendedprice) AS price_avg, sum(l.l_quantity) AS qty_total
      FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2)"""


@register("join_static_left", """
SELECT o.o_orderkey, c.c_mktsegment AS building_type, n.n_name AS region_name,
       r.r_name AS zone, c.c_acctbal AS area
FROM orders o
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def join_static_left(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey",
                                             "c_mktsegment", "c_acctbal")
    n = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name",
                                           "n_regionkey")
    r = T.table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    # nation/region are fixed-size code tables (25 / 5 rows): checked broadcast
    dim = (c.join(joins.checked_broadcast(n, 10_000), "c_nationkey", "left")
           .join(joins.checked_broadcast(r, 10_000), "n_regionkey", "left"))
    j = joins.enrich(o, dim, "o_custkey", "left")
    return j.select("o_orderkey", F.col("c_mktsegment").alias("building_type"),
                    F.col("n_name").alias("region_name"), F.col("r_name").alias("zone"),
                    F.col("c_acctbal").alias("area"))


@register("join_fact_dim", """
SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment AS building_type
FROM orders o JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey
""")
def join_fact_dim(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = (T.table(spark, d, "customer").where(F.col("c_acctbal") > 0)
         .select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("building_type")))
    return joins.enrich(o, c, "o_custkey", "inner")


@register("join_region_day", f"""
SELECT o.o_orderkey, c.c_nationkey AS region, CAST(o.o_orderdate AS DATE) AS date,
       round(w.price_avg, 6) AS price_avg, w.qty_total
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN {_W_SQL} w ON w.region = c.c_nationkey AND w.date = CAST(o.o_orderdate AS DATE)
""")
def join_region_day(spark, d):
    o = T.orders_panel(spark, d).select("o_orderkey", "o_custkey", "date")
    c = T.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"),
                                             F.col("c_nationkey").alias("region"))
    w = T.region_day_covariates(spark, d).select("region", "date", "price_avg", "qty_total")
    panel = joins.enrich(o, c, "o_custkey", "inner")
    # region x day covariates are an aggregate (bounded by regions x days):
    # AQE measures its shuffle output and broadcasts it at runtime, without
    # computing it a second time for a size check
    out = joins.enrich(panel, w, ["region", "date"], "left")
    return out.select("o_orderkey", "region", "date", F.round("price_avg", 6).alias("price_avg"),
                      "qty_total")


_SAMPLED_CUST = """(SELECT c_custkey FROM customer
  WHERE CAST(('0x' || substr(md5(concat_ws('#', CAST(c_custkey AS VARCHAR), '42')), 1, 8)) AS BIGINT)
        < 1288490188)"""


@register("semi_sampled", f"""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN {_SAMPLED_CUST}
""")
def semi_sampled(spark, d):
    cust = sampling.split_hash(T.table(spark, d, "customer"), ["c_custkey"], 0.3, 42, "_in")
    ids = cust.where(F.col("_in") == 1).select(F.col("c_custkey").alias("o_custkey"))
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return joins.member_of(o, ids, "o_custkey")


@register("anti_split", """
WITH h AS (SELECT o_orderkey, o_custkey,
  CAST(('0x' || substr(md5(concat_ws('#', CAST(o_orderkey AS VARCHAR), '7')), 1, 8)) AS BIGINT) AS hv
  FROM orders)
SELECT o_orderkey, o_custkey FROM h
WHERE o_orderkey NOT IN (SELECT o_orderkey FROM h WHERE hv < 3435973836)
""")
def anti_split(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    train = sampling.split_hash(o, ["o_orderkey"], 0.8, 7, "_tr").where(F.col("_tr") == 1)
    return joins.not_member_of(o, train, "o_orderkey")


@register("entity_median_joined", """
WITH m AS (SELECT o_custkey, median(o_totalprice) AS own_median FROM orders GROUP BY 1)
SELECT o.o_orderkey, o.o_custkey, round(m.own_median, 4) AS own_median,
       CAST(o.o_totalprice > m.own_median AS INTEGER) AS above_own_median
FROM orders o JOIN m USING (o_custkey)
""")
def entity_median_joined(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    m = quantiles_wide(o, "o_totalprice", [0.5], ["o_custkey"], ["own_median"])
    j = joins.attach_group_stat(o, m, ["o_custkey"])
    return j.select("o_orderkey", "o_custkey", F.round("own_median", 4).alias("own_median"),
                    (F.col("o_totalprice") > F.col("own_median")).cast("int").alias("above_own_median"))


@register("prediction_grid", """
WITH b AS (SELECT min(l_discount) AS lo, max(l_discount) AS hi, avg(l_tax) AS tax FROM lineitem),
g AS (SELECT CAST(i AS INTEGER) AS discount_idx, lo + i * (hi - lo) / 10 AS discount
      FROM b, range(11) t(i)),
f AS (SELECT DISTINCT l_returnflag FROM lineitem)
SELECT discount_idx, round(discount, 6) AS discount, l_returnflag, round(b.tax, 6) AS tax,
       'F' AS l_linestatus
FROM g, f, b
""")
def prediction_grid(spark, d):
    li = T.table(spark, d, "lineitem")
    b = li.agg(F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"),
               F.avg("l_tax").alias("tax"))
    seq = joins.linspace_grid(spark, "discount", b.select("lo", "hi"), 11)
    levels = li.select("l_returnflag").distinct()
    g = joins.prediction_grid(spark, seq, [levels], b.select(F.round("tax", 6).alias("tax")))
    g = joins.prediction_grid(spark, g, [], {"l_linestatus": "F"})
    return g.select("discount_idx", F.round("discount", 6).alias("discount"), "l_returnflag", "tax",
                    "l_linestatus")


@register("flag_above_median", """
WITH m AS (SELECT median(l_quantity) AS med FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(l_quantity > m.med AS INTEGER) AS high_quantity
FROM lineitem, m
""")
def flag_above_median(spark, d):
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    med = quantiles_wide(li, "l_quantity", [0.5], [], ["_med"])
    j = joins.attach_scalar(li, med)
    return j.select("l_orderkey", "l_linenumber",
                    (F.col("l_quantity") > F.col("_med")).cast("int").alias("high_quantity"))


@register("align_two_tables", """
WITH a AS (SELECT l_returnflag AS term, round(avg(l_discount), 6) AS estimate, count(*) AS n
           FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
b AS (SELECT l_returnflag AS term, round(avg(l_discount), 6) AS estimate, count(*) AS n
      FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1
      UNION ALL SELECT 'status_O', round(avg(l_tax), 6), count(*) FROM lineitem WHERE l_linestatus = 'O')
SELECT COALESCE(a.term, b.term) AS term, a.estimate AS estimate_f, a.n AS n_f,
       b.estimate AS estimate_o, b.n AS n_o
FROM a FULL OUTER JOIN b ON a.term = b.term
""")
def align_two_tables(spark, d):
    li = T.table(spark, d, "lineitem")
    a = (li.where(F.col("l_linestatus") == "F").groupBy(F.col("l_returnflag").alias("term"))
         .agg(F.round(F.avg("l_discount"), 6).alias("estimate"), F.count(F.lit(1)).alias("n")))
    o = li.where(F.col("l_linestatus") == "O")
    b = (o.groupBy(F.col("l_returnflag").alias("term"))
         .agg(F.round(F.avg("l_discount"), 6).alias("estimate"), F.count(F.lit(1)).alias("n"))
         .unionByName(o.agg(F.lit("status_O").alias("term"), F.round(F.avg("l_tax"), 6).alias("estimate"),
                            F.count(F.lit(1)).alias("n"))))
    return joins.align_by_key(a, b, "term", "_f", "_o")
