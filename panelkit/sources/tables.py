"""Driver parquet tables and the panel bindings used by the registered queries.

Bindings (entity, day, measure):
- L: lineitem, entity l_suppkey, day l_shipdate, measure l_quantity
- O: orders, entity o_custkey, day o_orderdate, measure o_totalprice,
     static dimension customer + nation + region
- E: events, entity user_id, day cast(ts as date), measure value
- W: region x day covariates: lineitem joined to supplier, grouped by
     (s_nationkey, ship day)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_panel(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("date", F.to_date("l_shipdate"))


def orders_panel(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.withColumn("date", F.to_date("o_orderdate"))


def events_panel(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("date", F.to_date("ts"))


def events_with_nulls(spark, sf_dir) -> DataFrame:
    """E+null: the same NULL injection the oracles use (value > 100 -> NULL)."""
    e = events_panel(spark, sf_dir)
    return e.withColumn("value", F.when(F.col("value") <= 100, F.col("value")))


def region_day_covariates(spark, sf_dir) -> DataFrame:
    """W: (s_nationkey, date) -> daily covariates derived from lineitem x supplier."""
    li = lineitem_panel(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(s, li.l_suppkey == s.s_suppkey, "inner")
    return (j.groupBy(F.col("s_nationkey").alias("region"), "date")
            .agg(F.avg("l_extendedprice").alias("price_avg"),
                 F.min("l_extendedprice").alias("price_min"),
                 F.max("l_extendedprice").alias("price_max"),
                 F.avg("l_discount").alias("discount_avg"),
                 F.sum("l_quantity").alias("qty_total")))
