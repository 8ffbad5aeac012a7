"""Row-wise preparation operators (projection, derivation, cleaning, contracts)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.functions import scalar as S


def transmute(df: DataFrame, mapping: Mapping[str, Column | str]) -> DataFrame:
    """Project, rename and cast in one select (dplyr ``transmute``)."""
    return df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in mapping.items()])


def safe_names(names: Sequence[str]) -> list[str]:
    """Syntactically safe, unique column names: non-word characters -> '.',
    a leading digit/underscore gets an 'X' prefix, duplicates get .1, .2."""
    import re
    out, seen = [], {}
    for n in names:
        m = re.sub(r"[^A-Za-z0-9_.]", ".", str(n))
        if not m or not (m[0].isalpha() or m[0] == "."):
            m = "X" + m
        k = seen.get(m, 0)
        seen[m] = k + 1
        out.append(m if k == 0 else f"{m}.{k}")
    return out


def rename(df: DataFrame, mapping: Mapping[str, str] | Sequence[str], make_safe: bool = False) -> DataFrame:
    """Rename by ``{old: new}`` or by position (a full list of new names)."""
    if isinstance(mapping, Mapping):
        out = df.withColumnsRenamed(dict(mapping))
    else:
        out = df.toDF(*mapping)
    return out.toDF(*safe_names(out.columns)) if make_safe else out


def mutate(df: DataFrame, *stages: Mapping[str, Column]) -> DataFrame:
    """Sequential derivation: each stage may use columns made by earlier ones."""
    for stage in stages:
        df = df.withColumns(dict(stage))
    return df


def add_calendar(df: DataFrame, date_col: str = "date",
                 parts: Sequence[str] = ("year", "month", "weekday", "is_weekend")) -> DataFrame:
    cols = S.calendar_columns(date_col)
    return df.withColumns({p: cols[p] for p in parts})


def complete_cases(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with NULL (or NaN) in ``cols`` (all columns if None)."""
    return df.dropna(how="any", subset=list(cols) if cols else None)


def fill_flags(df: DataFrame, cols: Sequence[str], value: int = 0) -> DataFrame:
    return df.fillna(value, subset=list(cols))


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key along ``order`` (ties must be broken by ``order``).

    Uses ``min_by`` on a struct: a partial aggregate holding one row per key
    per task, so a hot key never collects its rows in one task (a
    ``row_number`` window would).
    """
    key = list(key)
    rest = [c for c in df.columns if c not in key]
    packed = df.groupBy(*key).agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])).alias("_first"))
    return packed.select(*key, *[F.col("_first")[c].alias(c) for c in rest])


def contract_violations(df: DataFrame, required: Sequence[str] = (), binary: Sequence[str] = (),
                        positive: Sequence[str] = (), not_null: Sequence[str] = (),
                        max_rows: int | None = None, types: Mapping[str, str] | None = None,
                        at_most: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Check a data contract in one aggregation pass.

    Returns ``(check STRING, n_violations BIGINT)``: missing columns and type
    mismatches are schema checks (count 1), the rest count offending rows.
    ``at_most`` lists (a, b) pairs of columns with a <= b (a count and its
    exposure, say).
    """
    spark = df.sparkSession
    schema_rows = [(f"missing_column:{c}", 0 if c in df.columns else 1) for c in required]
    dtypes = dict(df.dtypes)
    for c, t in (types or {}).items():
        schema_rows.append((f"type:{c}", 0 if dtypes.get(c) == t else 1))
    aggs = []
    for c in binary:
        aggs.append(F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(0, 1)).alias(f"binary:{c}"))
    for c in positive:
        aggs.append(F.count_if(F.col(c) <= 0).alias(f"positive:{c}"))
    for a, b in at_most:
        aggs.append(F.count_if(F.col(a) > F.col(b)).alias(f"at_most:{a}<={b}"))
    for c in not_null:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"not_null:{c}"))
    aggs.append(F.count(F.lit(1)).alias("_rows"))
    agg = df.agg(*aggs)
    names = [c for c in agg.columns if c != "_rows"]
    stack_items = [x for n in names for x in (F.lit(n), F.col(f"`{n}`").cast("long"))]
    cap = (F.lit(0) if max_rows is None
           else F.when(F.col("_rows") > max_rows, F.lit(1)).otherwise(F.lit(0))).cast("long")
    stack_items += [F.lit("max_rows"), cap]
    long = agg.select(F.inline(F.array(*[F.struct(stack_items[i].alias("check"),
                                                    stack_items[i + 1].alias("n_violations"))
                                          for i in range(0, len(stack_items), 2)])))
    if schema_rows:
        long = long.unionByName(spark.createDataFrame(schema_rows, "check string, n_violations long"))
    return long


def assert_contract(violations: DataFrame) -> None:
    """Raise if any contract check fails (one small collect of the check table)."""
    bad = [r for r in violations.where(F.col("n_violations") > 0).collect()]
    if bad:
        raise ValueError("data contract violated: " + ", ".join(f"{r[0]}={r[1]}" for r in bad))
