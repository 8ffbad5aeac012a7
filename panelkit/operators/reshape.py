"""Wide<->long reshaping and appending tables by name (RS1, RS2, RS4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], var_name: str = "variable",
            value_name: str = "value", cast: str | None = "double") -> DataFrame:
    """Wide -> long; value columns are cast to one type first."""
    vals = list(values)
    src = df.select(*ids, *[(F.col(f"`{c}`").cast(cast) if cast else F.col(f"`{c}`")).alias(c)
                            for c in vals])
    return src.unpivot(list(ids), vals, var_name, value_name)


def pivot(df: DataFrame, ids: Sequence[str], names_from: str, values_from: str,
          levels: Sequence[str] | None = None, agg: str = "first") -> DataFrame:
    """Long -> wide; pass ``levels`` to skip the extra distinct-values job."""
    g = df.groupBy(*ids)
    p = g.pivot(names_from, list(levels)) if levels is not None else g.pivot(names_from)
    fn = {"first": F.first, "sum": F.sum, "max": F.max, "min": F.min, "avg": F.avg}[agg]
    return p.agg(fn(values_from))


def union_by_name(*dfs: DataFrame, allow_missing: bool = True) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=allow_missing)
    return out
