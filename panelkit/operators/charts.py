"""Chart data computed on Spark; drawing is left to the caller (CH1-CH6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.joins import null_safe_join
from panelkit.operators.prep import first_per_key
from panelkit.operators.quantile import quantiles_wide
from panelkit.operators.reshape import unpivot


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the global [min, max]; x = max goes to the last bin.

    Returns ``(by..., bin, bin_lo, bin_hi, n)``.
    """
    by = list(by)
    x = df.select(*by, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    rng = x.agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    w = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(w > 0, F.least(F.floor((F.col("_x") - F.col("_lo")) / w), F.lit(bins - 1))).otherwise(0)
    counts = (x.crossJoin(F.broadcast(rng)).withColumn("bin", b.cast("int"))
              .groupBy(*by, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n")))
    return counts.select(*by, "bin", (F.col("_lo") + F.col("bin") * w).alias("bin_lo"),
                         (F.col("_lo") + (F.col("bin") + 1) * w).alias("bin_hi"), "n")


def box_stats(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whisker ends (extreme values inside the
    fences) and outlier counts per group."""
    by = list(by)
    x = df.select(*by, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    q = quantiles_wide(x, "_x", [0.25, 0.5, 0.75], by, ["q1", "median", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")).withColumns({
        "lower_fence": F.col("q1") - 1.5 * F.col("iqr"), "upper_fence": F.col("q3") + 1.5 * F.col("iqr")})
    inside = F.col("_x").between(F.col("lower_fence"), F.col("upper_fence"))
    agg = null_safe_join(x, q.select(*by, "lower_fence", "upper_fence"), by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, F.col("_x"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))
    return null_safe_join(q, agg, by)


def flag_share_by(df: DataFrame, flag: str, by: Sequence[str], name: str = "pct_flagged") -> DataFrame:
    """% of rows flagged per group (e.g. per month)."""
    return df.groupBy(*by).agg((F.avg(F.col(flag).cast("double")) * 100).alias(name),
                               F.count(F.lit(1)).alias("n"))


def binary_share(df: DataFrame, entity: str, order: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Entity-level % per binary attribute: first row per entity, then the
    mean of each 0/1 flag, long form ``(attribute, pct, n_entities)``."""
    first = first_per_key(df.select(entity, *order, *flags), [entity], order)
    agg = first.agg(F.count(F.lit(1)).alias("n_entities"),
                    *[(F.avg(F.col(f).cast("double")) * 100).alias(f) for f in flags])
    return unpivot(agg, ["n_entities"], flags, "attribute", "pct")
