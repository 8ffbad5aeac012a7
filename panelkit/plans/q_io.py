"""Registered queries: checkpoints, metric sinks and the panel build (IO3,
IO6, entry A of the pipeline bound to the order tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelkit.operators import panel_build as PB
from panelkit.plans.registry import register
from panelkit.sources import io
from panelkit.sources import tables as T


@register("checkpoint_roundtrip", """
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS date, o_totalprice,
       CAST(year(o_orderdate) AS INTEGER) AS year FROM orders
""")
def checkpoint_roundtrip(spark, d):
    o = T.orders_panel(spark, d).select("o_orderkey", "o_custkey", "date", "o_totalprice",
                                        F.year("date").alias("year"))
    back = io.checkpoint_table(o, "orders_panel", partition_by=["year"])
    return back.select("o_orderkey", "o_custkey", "date", "o_totalprice", F.col("year").cast("int"))


@register("metrics_long", """
SELECT metric, value FROM (
  SELECT 'n_rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM lineitem
  UNION ALL SELECT 'n_entities', CAST(count(DISTINCT l_suppkey) AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'share_zero_tax', CAST(round(avg(CAST(l_tax = 0 AS DOUBLE)), 6) AS VARCHAR) FROM lineitem
  UNION ALL SELECT 'max_quantity', CAST(max(l_quantity) AS VARCHAR) FROM lineitem)
""")
def metrics_long(spark, d):
    li = T.table(spark, d, "lineitem")
    row = li.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("l_suppkey").alias("n_entities"),
                 F.round(F.avg((F.col("l_tax") == 0).cast("double")), 6).alias("share_zero_tax"),
                 F.max("l_quantity").alias("max_quantity"))
    # long form straight from the one-row aggregate (no driver round trip),
    # through the run-metrics sink
    long = row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns])))
    path = io.write_metrics(long, io.table_path(spark, f"metrics-{uuid.uuid4().hex[:12]}"))
    return spark.read.schema("metric string, value string").json(path)


@register("daily_panel", """
WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS Household_ID, CAST(o_orderdate AS DATE) AS date,
                  o_totalprice / 1000 AS kWh_total,
                  CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 2000 END AS kWh_heatpump
           FROM orders WHERE o_totalprice >= 0),
a AS (SELECT CAST(c.c_custkey AS VARCHAR) AS Household_ID, CAST(c.c_nationkey AS VARCHAR) AS weather_region,
             c.c_mktsegment AS building_type, c.c_acctbal AS living_area, n.n_regionkey + 1 AS n_residents
      FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
w AS (SELECT CAST(s.s_nationkey AS VARCHAR) AS weather_region, CAST(l.l_shipdate AS DATE) AS date,
             sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) / count(*) / 100000 AS temp_avg
      FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
      GROUP BY 1, 2)
SELECT r.Household_ID, r.date, CAST(year(r.date) AS INTEGER) AS year, CAST(month(r.date) AS INTEGER) AS month,
       CAST(isodow(r.date) AS INTEGER) AS weekday, CAST(isodow(r.date) >= 6 AS INTEGER) AS is_weekend,
       r.kWh_total, r.kWh_heatpump,
       CASE WHEN a.living_area > 0 THEN r.kWh_total / a.living_area END AS kWh_per_m2,
       w.temp_avg, a.weather_region, a.building_type, a.living_area, a.n_residents
FROM r JOIN a USING (Household_ID) LEFT JOIN w USING (weather_region, date)
WHERE w.temp_avg IS NOT NULL AND a.living_area IS NOT NULL
""")
def daily_panel(spark, d):
    o = T.orders_panel(spark, d)
    readings = o.select(F.col("o_custkey").cast("string").alias("Household_ID"), "date",
                        (F.col("o_totalprice") / 1000).alias("kWh_total"),
                        F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 2000).alias("kWh_heatpump")
                        ).where(F.col("kWh_total") >= 0)
    c = T.table(spark, d, "customer")
    n = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    attrs = c.join(n, "c_nationkey", "left").select(
        F.col("c_custkey").cast("string").alias("Household_ID"),
        F.col("c_nationkey").cast("string").alias("weather_region"),
        F.col("c_mktsegment").alias("building_type"), F.col("c_acctbal").alias("living_area"),
        (F.col("n_regionkey") + 1).alias("n_residents"))
    # covariate: mean price per (region, day) from exact integer cents, so the
    # value is the same double in every engine (no rounding needed to compare)
    li = T.lineitem_panel(spark, d)
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    w = (li.join(s, "l_suppkey").groupBy(F.col("s_nationkey").cast("string").alias("weather_region"), "date")
         .agg((F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.count(F.lit(1)) / 100000)
              .alias("temp_avg")))
    p = PB.assemble_panel(readings, attrs, w, core_vars=["kWh_total", "living_area", "temp_avg"],
                          columns=None)
    return p.select("Household_ID", "date", "year", "month", "weekday", "is_weekend",
                    "kWh_total", "kWh_heatpump", "kWh_per_m2", "temp_avg",
                    "weather_region", "building_type", "living_area", "n_residents")


@register("annual_dataset", """
WITH m AS (SELECT l_suppkey, year(l_shipdate) AS y, month(l_shipdate) AS mo, sum(l_quantity) AS tot,
                  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS ret
           FROM lineitem GROUP BY 1, 2, 3),
yr AS (SELECT l_suppkey, y, count(*) AS months, COALESCE(sum(tot), 0.0) AS tot, COALESCE(sum(ret), 0.0) AS ret
       FROM m GROUP BY 1, 2),
full_ AS (SELECT l_suppkey, tot * 12 / months AS tot, ret * 12 / months AS ret FROM yr WHERE months >= 10 AND tot > 0),
cons AS (SELECT l_suppkey, count(*) AS n_complete_years, quantile_cont(tot, 0.5) AS annual_kWh_total,
                quantile_cont(ret, 0.5) AS annual_kWh_returned FROM full_ GROUP BY 1),
wd AS (SELECT s.s_nationkey AS region, CAST(l.l_shipdate AS DATE) AS date, avg(l.l_extendedprice) AS price_avg,
              min(l.l_extendedprice) AS price_min, max(l.l_extendedprice) AS price_max, sum(l.l_quantity) AS qty_total
       FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey GROUP BY 1, 2),
wy AS (SELECT region, year(date) AS y, avg(price_avg) AS temp_avg, avg(price_max - price_min) AS temp_range,
              COALESCE(sum(qty_total), 0.0) AS heating_degree_days FROM wd GROUP BY 1, 2),
wa AS (SELECT region AS weather_region, avg(temp_avg) AS temp_avg, avg(temp_range) AS temp_range,
              avg(heating_degree_days) AS heating_degree_days FROM wy GROUP BY 1),
a AS (SELECT s.s_suppkey AS l_suppkey, s.s_nationkey AS weather_region, n.n_name AS building_type,
             s.s_acctbal AS living_area, n.n_regionkey + 1 AS n_residents
      FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey),
j AS (SELECT a.*, cons.n_complete_years, cons.annual_kWh_total, cons.annual_kWh_returned,
             wa.temp_avg, wa.temp_range, wa.heating_degree_days,
             CASE WHEN a.living_area > 0 THEN cons.annual_kWh_total / a.living_area END AS kWh_per_m2
      FROM a JOIN cons ON a.l_suppkey = cons.l_suppkey LEFT JOIN wa ON wa.weather_region = a.weather_region),
f AS (SELECT *, CAST(annual_kWh_total > (SELECT quantile_cont(annual_kWh_total, 0.5) FROM j) AS INTEGER)
                AS high_consumption FROM j)
SELECT CAST(l_suppkey AS VARCHAR) AS Household_ID, n_complete_years, round(annual_kWh_total, 6) AS annual_kWh_total,
       round(annual_kWh_returned, 6) AS annual_kWh_returned, living_area, round(temp_avg, 6) AS temp_avg,
       round(temp_range, 6) AS temp_range, round(heating_degree_days, 6) AS heating_degree_days,
       round(kWh_per_m2, 8) AS kWh_per_m2, weather_region, building_type, n_residents, high_consumption
FROM f WHERE annual_kWh_total IS NOT NULL AND living_area IS NOT NULL AND building_type IS NOT NULL
  AND weather_region IS NOT NULL AND n_residents IS NOT NULL
""")
def annual_dataset(spark, d):
    """Annual dataset pipeline on the supplier panel: monthly totals ->
    complete years scaled to 12 months -> median over years -> entity
    attributes and annual regional covariates -> above-median flag."""
    li = T.lineitem_panel(spark, d)
    monthly = li.groupBy("l_suppkey", F.year("date").alias("year"), F.month("date").alias("month")).agg(
        F.sum("l_quantity").alias("annual_kWh_total"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_quantity"))).alias("annual_kWh_returned"))
    cons = PB.annual_consumption(monthly, "l_suppkey", "year", ["annual_kWh_total", "annual_kWh_returned"],
                                 total="annual_kWh_total", min_months=10)
    w = T.region_day_covariates(spark, d)
    cov = PB.annual_covariates(w.withColumnRenamed("region", "weather_region"), "weather_region", "date",
                               means={"temp_avg": F.col("price_avg"),
                                      "temp_range": F.col("price_max") - F.col("price_min")},
                               sums={"heating_degree_days": F.col("qty_total")})
    s = T.table(spark, d, "supplier")
    n = T.table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    attrs = s.join(n, "s_nationkey", "left").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("weather_region"),
        F.col("n_name").alias("building_type"), F.col("s_acctbal").alias("living_area"),
        (F.col("n_regionkey") + 1).alias("n_residents"))
    out = PB.assemble_annual(attrs, cons, cov, "l_suppkey", "weather_region", "annual_kWh_total", "living_area",
                             core_vars=["annual_kWh_total", "living_area", "building_type", "weather_region",
                                        "n_residents"])
    return out.select(F.col("l_suppkey").cast("string").alias("Household_ID"), "n_complete_years",
                      F.round("annual_kWh_total", 6).alias("annual_kWh_total"),
                      F.round("annual_kWh_returned", 6).alias("annual_kWh_returned"), "living_area",
                      *[F.round(c, 6).alias(c) for c in ("temp_avg", "temp_range", "heating_degree_days")],
                      F.round("kWh_per_m2", 8).alias("kWh_per_m2"), "weather_region", "building_type",
                      "n_residents", "high_consumption")
