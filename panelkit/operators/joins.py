"""Joins: dimension enrichment, composite-key covariates, membership, splits,
scalar broadcast, prediction grids and coefficient alignment (JN1-JN9).

Broadcast policy: a side is hinted for broadcast only when its size is
bounded (a literal list, a one-row aggregate, a table proven small by a
capped count).  Everything else is left to Catalyst/AQE, which switches to a
broadcast at runtime only when the measured shuffle size is below
``spark.sql.adaptive.autoBroadcastJoinThreshold``, and otherwise shuffles
both sides on the join key (with AQE skew-join splitting of hot keys).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 2_000_000


def checked_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint only if a capped count proves at most ``max_rows`` rows.

    Meant for cheap inputs (small code tables read from storage).  For a side
    that is itself an expensive aggregate, leave the decision to AQE, which
    measures the materialised shuffle instead of computing the side twice.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def enrich(fact: DataFrame, dim: DataFrame, on, how: str = "left",
           broadcast: str = "auto", max_rows: int = DEFAULT_MAX_BROADCAST_ROWS,
           null_safe: bool = False) -> DataFrame:
    """Join a dimension onto a fact table.

    ``broadcast``: 'auto' (Catalyst/AQE decide from sizes), 'checked'
    (capped count, then hint), 'never'.  ``null_safe`` matches NULL keys to
    NULL keys (as dplyr joins do) via ``<=>``; the key columns are kept once.
    """
    if broadcast == "checked":
        dim = checked_broadcast(dim, max_rows)
    if not null_safe:
        return fact.join(dim, on, how)
    keys = [on] if isinstance(on, str) else list(on)
    d = dim.select(*[F.col(k).alias(f"_rk_{k}") for k in keys], *[c for c in dim.columns if c not in keys])
    cond = None
    for k in keys:
        c = fact[k].eqNullSafe(d[f"_rk_{k}"])
        cond = c if cond is None else cond & c
    return fact.join(d, cond, how).drop(*[f"_rk_{k}" for k in keys])


def null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` matching NULL to NULL (a NULL group key is a group),
    keeping one copy of the key columns.  ``b`` may carry a broadcast hint."""
    keys = list(keys)
    if not keys:
        return a.crossJoin(b) if how == "inner" else a.join(b, how=how)
    rb = b.select(*[F.col(c).alias(f"_nsk_{c}") if c in keys else F.col(c) for c in b.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_nsk_{k}"))
        cond = c if cond is None else cond & c
    out = a.join(rb, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"_nsk_{k}" for k in keys])


def member_of(df: DataFrame, ids: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key is in ``ids`` (``%in%``): a left-semi join."""
    return df.join(ids.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_semi")


def not_member_of(df: DataFrame, ids: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return df.join(ids.select(*([key] if isinstance(key, str) else key)).distinct(), key, "left_anti")


def attach_group_stat(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join a per-group aggregate back to every row of its group."""
    return null_safe_join(df, stats, by, "left")


def attach_scalar(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Join a one-row aggregate to every row (broadcast of one row)."""
    return df.crossJoin(F.broadcast(one_row))


def linspace_grid(spark: SparkSession, name: str, lo_hi: DataFrame, n: int) -> DataFrame:
    """``n`` evenly spaced values between the ``lo``/``hi`` of a one-row frame."""
    idx = spark.range(n).withColumnRenamed("id", "_i")
    step = (F.col("hi") - F.col("lo")) / F.lit(max(n - 1, 1))
    return idx.crossJoin(F.broadcast(lo_hi)).select(
        F.col("_i").cast("int").alias(f"{name}_idx"), (F.col("lo") + F.col("_i") * step).alias(name))


def prediction_grid(spark: SparkSession, seq: DataFrame, levels: Sequence[DataFrame] = (),
                    constants: Mapping[str, object] | DataFrame | None = None,
                    max_levels: int = 1000) -> DataFrame:
    """Cartesian grid: a value sequence x factor levels x constants (JN7).

    ``seq`` has n grid points and ``constants`` one row; a level list that
    comes from data is counted, and more than ``max_levels`` levels raise (a
    grid over them is a mistake, not a plan to run).
    """
    g = seq
    for lv in levels:
        if lv.limit(max_levels + 1).count() > max_levels:
            raise ValueError(f"{lv.columns} has more than {max_levels} levels")
        g = g.crossJoin(F.broadcast(lv))
    if isinstance(constants, DataFrame):
        g = g.crossJoin(F.broadcast(constants))
    elif constants:
        g = g.select("*", *[F.lit(v).alias(k) for k, v in constants.items()])
    return g


def align_by_key(a: DataFrame, b: DataFrame, key: str, suffix_a: str, suffix_b: str) -> DataFrame:
    """Full outer alignment of two keyed tables; columns suffixed per side."""
    ra = a.select(key, *[F.col(c).alias(f"{c}{suffix_a}") for c in a.columns if c != key])
    rb = b.select(key, *[F.col(c).alias(f"{c}{suffix_b}") for c in b.columns if c != key])
    return ra.join(rb, key, "full")
