"""Feature engineering: treatment-coded dummies, interactions, train-only
standardisation and derived responses (FE1-FE5).

Factor levels are tiny (a handful of categories); collecting the sorted
level list to the driver is the only driver step and is bounded by
``max_levels``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators.joins import null_safe_join
from panelkit.operators.quantile import quantiles_wide


def factor_levels(df: DataFrame, col: str, max_levels: int = 1000) -> list:
    """Sorted distinct non-NULL levels (reference level first, as R factors)."""
    return factors_levels(df, [col], max_levels)[col]


def factors_levels(df: DataFrame, cols: Sequence[str], max_levels: int = 1000) -> dict[str, list]:
    """The level lists of several factors in one scan: the distinct (factor,
    level) pairs come from one partial aggregate; more than ``max_levels``
    levels of a factor raise."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("s")) for i, c in enumerate(cols)])).alias("p")) \
        .select("p.i", "p.s").where(F.col("s").isNotNull()).distinct()
    found = pairs.limit(len(cols) * (max_levels + 1)).collect()
    out = {}
    for i, c in enumerate(cols):
        kind = df.schema[c].dataType
        levels = [r["s"] for r in found if r["i"] == i]
        if len(levels) > max_levels or len(found) > len(cols) * max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
        if not isinstance(kind, T.StringType):
            typed = df.sparkSession.createDataFrame([(s,) for s in levels], "s string").select(F.col("s").cast(kind))
            levels = [r[0] for r in typed.collect()]
        out[c] = sorted(levels)
    return out


def level_name(col: str, level) -> str:
    return f"{col}_" + re.sub(r"[^A-Za-z0-9_]", "_", str(level))


def dummy_columns(df: DataFrame, col: str, levels: Sequence, drop_first: bool = True) -> tuple[DataFrame, list[str]]:
    """0/1 indicator per level (the first level is the reference when
    ``drop_first``); unused levels are simply absent from ``levels``."""
    use = list(levels)[1:] if drop_first else list(levels)
    names = [level_name(col, lv) for lv in use]
    out = df.withColumns({n: (F.col(col) == F.lit(lv)).cast("int") for n, lv in zip(names, use)})
    return out, names


def interaction_columns(df: DataFrame, numeric: str, dummies: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """numeric x dummy products (treatment-coded interaction, no full-rank clash)."""
    names = [f"{numeric}_x_{d}" for d in dummies]
    return df.withColumns({n: F.col(numeric) * F.col(d) for n, d in zip(names, dummies)}), names


def train_stats(df: DataFrame, cols: Sequence[str], train_flag: str | None = None) -> DataFrame:
    """One-row mean/sd per column, from training rows only."""
    src = df.where(F.col(train_flag) == 1) if train_flag else df
    return src.agg(*[F.avg(c).alias(f"{c}__mean") for c in cols],
                   *[F.stddev_samp(c).alias(f"{c}__sd") for c in cols])


def standardise(df: DataFrame, cols: Sequence[str], stats: DataFrame, suffix: str = "") -> DataFrame:
    """(x - mean) / sd with train statistics; sd of 0 or NULL is replaced by 1
    (a constant column stays centred, not zeroed)."""
    j = df.crossJoin(F.broadcast(stats))
    for c in cols:
        sd = F.col(f"{c}__sd")
        j = j.withColumn(f"{c}{suffix}", (F.col(c) - F.col(f"{c}__mean")) /
                         F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd))
    return j.drop(*[x for c in cols for x in (f"{c}__mean", f"{c}__sd")])


def label_by_quantile(df: DataFrame, col: str, q: float, out: str, cmp: str = ">=",
                      by: Sequence[str] = ()) -> DataFrame:
    """0/1 label: value compared with the q-quantile (global or per group)."""
    by = list(by)
    thr = quantiles_wide(df.select(*by, col), col, [q], by, ["_thr"])
    j = null_safe_join(df, thr, by, "left") if by else df.crossJoin(F.broadcast(thr))
    ops = {">=": F.col(col) >= F.col("_thr"), ">": F.col(col) > F.col("_thr")}
    return j.withColumn(out, ops[cmp].cast("int")).drop("_thr")


def label_above_median(df: DataFrame, col: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    return label_by_quantile(df, col, 0.5, out, ">", by)


def responses(df: DataFrame, col: str, label: str = "high_consumption",
              log_name: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Derived responses: above-median flag (global, or own-group median via
    ``by``) and a guarded natural log (NULL for values <= 0)."""
    out = label_above_median(df, col, label, by)
    if log_name:
        out = out.withColumn(log_name, F.when(F.col(col) > 0, F.ln(col)))
    return out
