"""Registered queries: projections, filters, scalar functions, reshape (PF, SC, RS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelkit import constants as K
from panelkit.functions import scalar as S
from panelkit.operators import prep, reshape
from panelkit.operators.quantile import quantiles_wide
from panelkit.plans.registry import register
from panelkit.sources import tables as T


@register("median_by_day", """
SELECT CAST(l_shipdate AS DATE) AS date,
       CAST(median(l_quantity) AS DOUBLE) AS median_quantity,
       count(*) AS n_rows
FROM lineitem GROUP BY 1
""")
def median_by_day(spark, d):
    li = T.lineitem_panel(spark, d).select("date", "l_quantity")
    # (day, value) counts carry both the row count and the exact median
    counts = li.groupBy("date", "l_quantity").agg(F.count(F.lit(1)).alias("c"))
    return counts.groupBy("date").agg(F.percentile("l_quantity", F.lit(0.5), F.col("c")).alias("median_quantity"),
                                      F.sum("c").alias("n_rows"))


@register("quantiles", """
SELECT l_returnflag,
       round(quantile_cont(l_extendedprice, 0.05), 6) AS q05,
       round(quantile_cont(l_extendedprice, 0.25), 6) AS q25,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
       round(quantile_cont(l_extendedprice, 0.75), 6) AS q75,
       round(quantile_cont(l_extendedprice, 0.95), 6) AS q95
FROM lineitem GROUP BY 1
""")
def quantiles(spark, d):
    li = T.table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice")
    names = ["q05", "q25", "q50", "q75", "q95"]
    q = quantiles_wide(li, "l_extendedprice", [0.05, 0.25, 0.5, 0.75, 0.95], ["l_returnflag"], names)
    return q.select("l_returnflag", *[F.round(n, 6).alias(n) for n in names])


@register("calendar_parts", """
SELECT o_orderkey,
       CAST(o_orderdate AS DATE) AS date,
       CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS DATE) AS date_from_text,
       CAST(year(o_orderdate) AS INTEGER) AS year,
       CAST(month(o_orderdate) AS INTEGER) AS month,
       CAST(isodow(o_orderdate) AS INTEGER) AS weekday,
       CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS is_weekend,
       strftime(o_orderdate, '%Y-%m') AS year_month,
       strftime(o_orderdate, '%b') AS month_label
FROM orders
""")
def calendar_parts(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    o = o.withColumn("date", S.as_date("o_orderdate")).withColumn(
        "date_from_text", S.iso_prefix_date(F.col("o_orderdate").cast("string")))
    cal = S.calendar_columns("date")
    return o.select("o_orderkey", "date", "date_from_text", *[cal[k].alias(k) for k in
                    ("year", "month", "weekday", "is_weekend", "year_month", "month_label")])


@register("project_cast", """
SELECT CAST(o_custkey AS VARCHAR) AS entity_id, o_orderkey AS order_id,
       CAST(o_orderdate AS DATE) AS date, o_totalprice AS amount,
       TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
       TRY_CAST(o_orderstatus AS DOUBLE) AS status_as_number
FROM orders
""")
def project_cast(spark, d):
    o = T.table(spark, d, "orders")
    return prep.transmute(o, {
        "entity_id": F.col("o_custkey").cast("string"),
        "order_id": "o_orderkey",
        "date": S.as_date("o_orderdate"),
        "amount": "o_totalprice",
        "priority": F.substring("o_orderpriority", 1, 1).try_cast("int"),
        "status_as_number": S.safe_double("o_orderstatus"),
    })


@register("derive_calendar", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date,
       CAST(isodow(o_orderdate) AS INTEGER) AS weekday,
       CAST(isodow(o_orderdate) >= 6 AS INTEGER) AS is_weekend,
       round(o_totalprice / 1000, 6) AS amount_k,
       CASE WHEN o_totalprice / 1000 >= 200 THEN 'large'
            WHEN o_totalprice / 1000 >= 50 THEN 'medium' ELSE 'small' END AS size_band
FROM orders
""")
def derive_calendar(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    out = prep.mutate(
        o,
        {"date": S.as_date("o_orderdate"), "amount_k": F.col("o_totalprice") / 1000},
        {"weekday": S.iso_weekday("date"),
         "size_band": S.band("amount_k", [(200, "large"), (50, "medium")], "small")},
        {"is_weekend": (F.col("weekday") >= 6).cast("int")},
    )
    return out.select("o_orderkey", "date", "weekday", "is_weekend",
                      F.round("amount_k", 6).alias("amount_k"), "size_band")


@register("filter_window", """
SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS date, o_totalprice
FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'
  AND o_totalprice IS NOT NULL AND o_totalprice >= 0
""")
def filter_window(spark, d):
    o = T.orders_panel(spark, d)
    return (o.where(F.col("date").between(F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date"))
                    & F.col("o_totalprice").isNotNull() & (F.col("o_totalprice") >= 0))
            .select("o_orderkey", "o_custkey", "date", "o_totalprice"))


_E_NULL = "(SELECT event_id, user_id, event_type, ts, CAST(ts AS DATE) AS date, " \
          "CASE WHEN value <= 100 THEN value END AS value FROM events)"


@register("complete_cases", f"""
SELECT event_id, user_id, date, value FROM {_E_NULL} e WHERE value IS NOT NULL
""")
def complete_cases(spark, d):
    e = T.events_with_nulls(spark, d).select("event_id", "user_id", "date", "value")
    return prep.complete_cases(e, ["value"])


@register("fill_flags", f"""
SELECT event_id, COALESCE(CAST(value > 50 AS INTEGER), 0) AS is_high,
       COALESCE(CAST(event_type = 'purchase' AS INTEGER), 0) AS is_purchase
FROM {_E_NULL} e
""")
def fill_flags(spark, d):
    e = T.events_with_nulls(spark, d)
    e = e.select("event_id", (F.col("value") > 50).cast("int").alias("is_high"),
                 (F.col("event_type") == "purchase").cast("int").alias("is_purchase"))
    return prep.fill_flags(e, ["is_high", "is_purchase"])


@register("guarded_ratio", """
SELECT o.o_orderkey,
       round(CASE WHEN c.c_acctbal IS NOT NULL AND c.c_acctbal > 0
                  THEN o.o_totalprice / c.c_acctbal END, 6) AS amount_per_balance
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""")
def guarded_ratio(spark, d):
    o = T.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = T.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    return j.select("o_orderkey", F.round(S.guarded_ratio("o_totalprice", "c_acctbal"), 6)
                    .alias("amount_per_balance"))


@register("recode_labels", """
SELECT o_orderkey,
       CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open'
                          WHEN 'P' THEN 'partial' ELSE o_orderstatus END AS status_label,
       regexp_replace(o_orderpriority, '^[0-9]-', '') AS priority_label
FROM orders
""")
def recode_labels(spark, d):
    o = T.table(spark, d, "orders")
    return o.select("o_orderkey",
                    S.recode("o_orderstatus", {"F": "finished", "O": "open", "P": "partial"})
                    .alias("status_label"),
                    F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("priority_label"))


@register("contract_violations", """
SELECT 'binary:is_weekend' AS "check", CAST(count(*) FILTER (WHERE isodow(ts) >= 6 AND 0 = 1) AS BIGINT) AS n_violations FROM events
UNION ALL SELECT 'positive:value', CAST(count(*) FILTER (WHERE value <= 0) AS BIGINT) FROM events
UNION ALL SELECT 'not_null:value', CAST(count(*) FILTER (WHERE value > 100) AS BIGINT) FROM events
UNION ALL SELECT 'max_rows', CAST(CASE WHEN count(*) > 5000 THEN 1 ELSE 0 END AS BIGINT) FROM events
UNION ALL SELECT 'missing_column:user_id', CAST(0 AS BIGINT)
UNION ALL SELECT 'missing_column:household_id', CAST(1 AS BIGINT)
UNION ALL SELECT 'type:date', CAST(0 AS BIGINT)
""")
def contract_violations(spark, d):
    e = T.events_with_nulls(spark, d).withColumn(
        "is_weekend", (S.iso_weekday("date") >= 6).cast("int"))
    return prep.contract_violations(
        e, required=["user_id", "household_id"], binary=["is_weekend"], positive=["value"],
        not_null=["value"], max_rows=5000, types={"date": "date"})


@register("distinct_pairs", """
SELECT DISTINCT o_custkey, o_orderstatus FROM orders
""")
def distinct_pairs(spark, d):
    return prep.distinct_rows(T.table(spark, d, "orders"), ["o_custkey", "o_orderstatus"])


@register("first_per_entity", """
SELECT o_custkey, o_orderkey, date, o_totalprice FROM (
  SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS date, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders) WHERE rn = 1
""")
def first_per_entity(spark, d):
    o = T.orders_panel(spark, d).select("o_custkey", "o_orderkey", "date", "o_totalprice")
    return prep.first_per_key(o, ["o_custkey"], ["date", "o_orderkey"])


@register("safe_casts", """
SELECT event_id,
       TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS INTEGER) AS k,
       TRY_CAST(event_type AS DOUBLE) AS event_type_num,
       TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value_roundtrip,
       CAST(trunc(value) AS INTEGER) AS value_int_cast,
       CASE WHEN event_type = 'click' THEN 1 WHEN event_type = 'view' THEN 0 END AS click_flag
FROM events
""")
def safe_casts(spark, d):
    e = T.table(spark, d, "events")
    # value_int_cast: R as.integer truncates, as does a Spark cast
    return e.select(
        "event_id",
        F.regexp_extract("props", '"k": ([0-9]+)', 1).try_cast("int").alias("k"),
        S.safe_double("event_type").alias("event_type_num"),
        S.safe_double(F.col("value").cast("string")).alias("value_roundtrip"),
        F.col("value").try_cast("int").alias("value_int_cast"),
        S.safe_bool_int(F.when(F.col("event_type") == "click", "TRUE")
                        .when(F.col("event_type") == "view", "F")).alias("click_flag"),
    )


@register("math_fns", """
SELECT l_linenumber,
       round(sum(CASE WHEN l_discount > 0 THEN ln(l_discount) END), 6) AS sum_log_discount,
       round(sum(exp(l_tax)), 6) AS sum_exp_tax,
       round(sum(sqrt(l_quantity)), 6) AS sum_sqrt_qty,
       round(sum(abs(l_discount - 0.05)), 6) AS sum_abs_dev,
       round(sum(l_quantity * l_quantity), 6) AS sum_sq_qty,
       count(*) FILTER (WHERE l_discount <= 0) AS n_log_dropped
FROM lineitem GROUP BY 1
""")
def math_fns(spark, d):
    li = T.table(spark, d, "lineitem")
    return li.groupBy("l_linenumber").agg(
        F.round(F.sum(S.safe_log("l_discount")), 6).alias("sum_log_discount"),
        F.round(F.sum(F.exp("l_tax")), 6).alias("sum_exp_tax"),
        F.round(F.sum(F.sqrt("l_quantity")), 6).alias("sum_sqrt_qty"),
        F.round(F.sum(F.abs(F.col("l_discount") - 0.05)), 6).alias("sum_abs_dev"),
        F.round(F.sum(F.col("l_quantity") * F.col("l_quantity")), 6).alias("sum_sq_qty"),
        F.count_if(F.col("l_discount") <= 0).alias("n_log_dropped"),
    )


@register("round_signif", """
WITH r AS (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS revenue
           FROM lineitem GROUP BY 1)
SELECT l_suppkey,
       CASE WHEN revenue = 0 THEN 0.0 ELSE
         round(revenue * pow(10.0, 2 - floor(log10(abs(revenue)))))
         / pow(10.0, 2 - floor(log10(abs(revenue)))) END AS revenue_3sig,
       round(revenue, 1) AS revenue_1dp
FROM r
""")
def round_signif(spark, d):
    li = T.table(spark, d, "lineitem")
    r = li.groupBy("l_suppkey").agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    return r.select("l_suppkey", S.signif("revenue", 3).alias("revenue_3sig"),
                    F.round("revenue", 1).alias("revenue_1dp"))


@register("string_fns", """
SELECT o_orderkey,
       'cust-' || CAST(o_custkey AS VARCHAR) AS label,
       printf('%s|%.2f', o_orderstatus, o_totalprice) AS status_amount,
       regexp_replace(o_orderpriority, '^[0-9]-', '') AS priority,
       CAST(regexp_matches(o_orderpriority, 'URGENT|HIGH') AS INTEGER) AS is_urgent,
       regexp_replace(lower(o_orderpriority), '[^a-z0-9_]', '_', 'g') AS safe_priority
FROM orders
""")
def string_fns(spark, d):
    o = T.table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        F.concat(F.lit("cust-"), F.col("o_custkey").cast("string")).alias("label"),
        F.format_string("%s|%.2f", "o_orderstatus", "o_totalprice").alias("status_amount"),
        F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("priority"),
        F.col("o_orderpriority").rlike("URGENT|HIGH").cast("int").alias("is_urgent"),
        F.regexp_replace(F.lower("o_orderpriority"), "[^a-z0-9_]", "_").alias("safe_priority"),
    )


@register("split_name", """
WITH s AS (
  SELECT 'o_totalprice_mean' AS name, round(avg(o_totalprice), 4) AS value FROM orders
  UNION ALL SELECT 'o_totalprice_max', round(max(o_totalprice), 4) FROM orders
  UNION ALL SELECT 'o_custkey_n_distinct', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders)
SELECT regexp_extract(name, '^(.*)_([^_]+)$', 1) AS variable,
       regexp_extract(name, '^(.*)_([^_]+)$', 2) AS stat, value FROM s
""")
def split_name(spark, d):
    o = T.table(spark, d, "orders")
    wide = o.agg(F.round(F.avg("o_totalprice"), 4).alias("o_totalprice_mean"),
                 F.round(F.max("o_totalprice"), 4).alias("o_totalprice_max"),
                 F.count_distinct("o_custkey").cast("double").alias("o_custkey_n_distinct"))
    long = reshape.unpivot(wide, [], wide.columns, "name", "value")
    var, stat = S.split_last_underscore("name")
    return long.select(var.alias("variable"), stat.alias("stat"), "value")


@register("coverage_bands", f"""
WITH w AS (SELECT min(CAST(ts AS DATE)) AS d0, max(CAST(ts AS DATE)) AS d1 FROM events),
days AS (SELECT user_id, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY 1),
cov AS (SELECT user_id, n_days,
          round_even(n_days * 100.0 / (date_diff('day', w.d0, w.d1) + 1), 1) AS coverage_pct
        FROM days, w)
SELECT CASE WHEN coverage_pct >= 75 THEN '{K.COVERAGE_BANDS[0][1]}'
            WHEN coverage_pct >= 40 THEN '{K.COVERAGE_BANDS[1][1]}'
            ELSE '{K.COVERAGE_LOW}' END AS coverage_band,
       count(*) AS n_entities,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct
FROM cov GROUP BY 1
""")
def coverage_bands(spark, d):
    from panelkit.operators import panel
    e = T.events_panel(spark, d)
    cov = panel.coverage(e, "user_id", "date")
    banded = cov.withColumn("coverage_band", S.band(F.bround("coverage_pct", 1), K.COVERAGE_BANDS,
                                                    K.COVERAGE_LOW))
    from panelkit.operators import aggregate
    return aggregate.freq_pct(banded, ["coverage_band"], count_name="n_entities", pct_name="pct")
