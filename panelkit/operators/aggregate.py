"""Grouped aggregates and data-quality profiles (AG*).

Every profile is one generated ``agg`` (a single pass, partial aggregation
on the map side), reshaped to long form afterwards on the small result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.joins import null_safe_join
from panelkit.operators.quantile import quantiles_wide
from panelkit.operators.reshape import unpivot

_FNS = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "sd": F.stddev_samp,
    "n": lambda c: F.count(c), "n_missing": lambda c: F.count_if(F.col(c).isNull()),
}


def n_distinct(df: DataFrame, col: str, by: Sequence[str] = (), approx: bool = False,
               rsd: float = 0.01, name: str = "n_distinct", rows: str | None = None) -> DataFrame:
    """Distinct count, global or per group.  Exact counts are a two-level
    aggregation ((by, col) first, so hot groups spread); ``approx`` uses the
    HyperLogLog++ sketch (bounded state, relative error ``rsd``).  ``rows``
    names a column for the row count, from the same scan."""
    by = list(by)
    if approx:
        aggs = [F.approx_count_distinct(col, rsd).alias(name), *([F.count(F.lit(1)).alias(rows)] if rows else [])]
        return df.groupBy(*by).agg(*aggs)
    pairs = df.groupBy(*by, col).agg(F.count(F.lit(1)).alias("_rows"))
    aggs = [F.count(col).alias(name), *([F.coalesce(F.sum("_rows"), F.lit(0)).alias(rows)] if rows else [])]
    return pairs.groupBy(*by).agg(*aggs)


def freq_pct(df: DataFrame, by: Sequence[str], count_name: str = "n", pct_name: str = "pct",
             digits: int = 1) -> DataFrame:
    """Frequency table with share of total (R ``round``: half-even)."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(count_name))
    total = counts.agg(F.sum(count_name).alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
            .withColumn(pct_name, F.bround(F.col(count_name) * 100.0 / F.col("_total"), digits)).drop("_total"))


def group_sums(df: DataFrame, by: Sequence[str], cols: Sequence[str], count_name: str = "n_rows",
               prefix: str = "", present: str | None = None) -> DataFrame:
    """Row count plus sums where an all-NULL group sums to 0 (R ``na.rm``);
    ``present`` (a pattern with {col}) also counts the non-NULL values."""
    aggs = [F.count(F.lit(1)).alias(count_name)]
    aggs += [F.count(c).alias(present.format(col=c)) for c in cols] if present else []
    aggs += [F.coalesce(F.sum(c), F.lit(0.0)).alias(f"{prefix}{c}") for c in cols]
    return df.groupBy(*by).agg(*aggs)


def across(df: DataFrame, by: Sequence[str], cols: Sequence[str], fns: Sequence[str],
           names: str = "{col}_{fn}") -> DataFrame:
    """Same aggregates over many columns in one pass."""
    aggs = [_FNS[f](c).alias(names.format(col=c, fn=f)) for c in cols for f in fns]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def summary_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                  quantile_method: str = "exact") -> DataFrame:
    """Long ``(by..., variable, n, min, q1, median, mean, q3, max, sd)``.

    Moments of all variables come from one wide aggregate whose small result
    is laid out long; only the exact quantiles see rows in long form, already
    counted per value (so each variable's group spreads).
    """
    by, cols = list(by), list(cols)
    wide = df.groupBy(*by).agg(*[f(F.col(c).cast("double")).alias(f"{k}_{i}") for i, c in enumerate(cols) for k, f in (
        ("n", F.count), ("min", F.min), ("mean", F.avg), ("max", F.max), ("sd", F.stddev_samp))])
    rows = [F.struct(F.lit(c).alias("variable"), *[F.col(f"{k}_{i}").alias(k) for k in ("n", "min", "mean", "max", "sd")])
            for i, c in enumerate(cols)]
    moments = wide.select(*by, F.inline(F.array(*rows))).where(F.col("n") > 0)
    long = unpivot(df, by, cols, "variable", "value").where(F.col("value").isNotNull())
    qs = quantiles_wide(long, "value", [0.25, 0.5, 0.75], by + ["variable"], ["q1", "median", "q3"],
                        method=quantile_method)
    return null_safe_join(moments, qs, by + ["variable"], "left")


def _missing(df: DataFrame, col: str) -> Column:
    """NULL, or NaN in a floating-point column."""
    c = F.col(f"`{col}`")
    floating = dict(df.dtypes)[col] in ("double", "float")
    return c.isNull() | F.isnan(c) if floating else c.isNull()


def na_profile(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 2) -> DataFrame:
    """``(variable, n_missing, pct_missing)`` for every column, one pass."""
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(_missing(df, c)).alias(c) for c in cols])
    long = agg.unpivot(["_rows"], cols, "variable", "n_missing")
    return long.select("variable", "n_missing",
                       F.bround(F.col("n_missing") * 100.0 / F.col("_rows"), digits).alias("pct_missing"))


def missingness_pattern(df: DataFrame, entity: str, col: str, labels: Sequence[str]) -> DataFrame:
    """Per entity: always / never / partly missing; then counts of entities.

    ``labels`` = (always, never, partly).
    """
    always, never, partly = labels
    per = df.groupBy(entity).agg((F.avg(F.col(col).isNull().cast("double")) * 100).alias("pct_missing"))
    cat = (F.when(F.col("pct_missing") == 100, F.lit(always))
           .when(F.col("pct_missing") == 0, F.lit(never)).otherwise(F.lit(partly)))
    return freq_pct(per.withColumn("category", cat), ["category"], "n_entities", "pct")


def rule_table(df: DataFrame, rules: Mapping[str, tuple[Column, str]], digits: int = 2) -> DataFrame:
    """Named predicate -> ``(rule, n_flagged, n_checked, pct_flagged)``.

    ``rules[name] = (predicate, column)``: the percentage is over rows where
    the column is not NULL.  One aggregation pass for all rules.
    """
    aggs = []
    for i, (name, (pred, c)) in enumerate(rules.items()):
        aggs += [F.count_if(F.col(c).isNotNull() & pred).alias(f"f{i}"),
                 F.count(F.col(c)).alias(f"c{i}")]
    agg = df.agg(*aggs)
    rows = [F.struct(F.lit(name).alias("rule"), F.col(f"f{i}").alias("n_flagged"),
                     F.col(f"c{i}").alias("n_checked")) for i, name in enumerate(rules)]
    out = agg.select(F.inline(F.array(*rows)))
    return out.withColumn("pct_flagged",
                          F.bround(F.try_divide(F.col("n_flagged") * 100.0, F.col("n_checked")), digits))


def dup_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def dataset_overview(df: DataFrame, entity: str, date: str) -> DataFrame:
    """One row: rows, columns, entities, first/last day, span in days."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_entities"),
                  F.min(date).alias("first_date"), F.max(date).alias("last_date")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_entities", "first_date", "last_date",
        (F.datediff("last_date", "first_date") + 1).alias("span_days"))


def zero_share(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.avg((F.col(col) == 0).cast("double")).alias("share_zero"),
                  F.count(col).alias("n"))


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """Long Pearson matrix, pairwise-complete (``F.corr`` skips NULL pairs).

    Only the upper triangle is aggregated (one pass, p(p+1)/2 pairs, which
    keeps the aggregate inside whole-stage codegen); the result is mirrored.
    """
    cols = list(cols)
    upper = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    aggs = [F.corr(cols[i], cols[j]).alias(f"r{i}_{j}") for i, j in upper]
    aggs += [F.count(F.when(F.col(cols[i]).isNotNull() & F.col(cols[j]).isNotNull(), 1)).alias(f"n{i}_{j}")
             for i, j in upper]
    agg = df.agg(*aggs)
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            lo, hi = min(i, j), max(i, j)
            rows.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                                 F.round(F.col(f"r{lo}_{hi}"), digits).alias("r"),
                                 F.col(f"n{lo}_{hi}").alias("n_pairs")))
    return agg.select(F.inline(F.array(*rows)))


def contingency(df: DataFrame, a: str, b: str, levels_a: Sequence | None = None,
                levels_b: Sequence | None = None, max_levels: int = 1000) -> DataFrame:
    """Two-way counts, zero-filled over all level pairs.

    The counts are one partial aggregate.  Levels taken from the data (a NULL
    is a level) are read off its result, counted, and refused beyond
    ``max_levels``: a zero-filled table over more is not meant.
    """
    spark = df.sparkSession
    counts = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    for c, given in ((a, levels_a), (b, levels_b)):
        if given is None and df.select(c).distinct().limit(max_levels + 1).count() > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
    la = (spark.createDataFrame([(x,) for x in levels_a], [a]) if levels_a is not None
          else counts.select(a).distinct())
    lb = (spark.createDataFrame([(x,) for x in levels_b], [b]) if levels_b is not None
          else counts.select(b).distinct())
    grid = la.crossJoin(lb)
    return null_safe_join(grid, counts, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).alias("n"))


def _as_key(name: str, dtype: str) -> Column:
    """The column's value as text, equal exactly where values are equal (0.0 and -0.0 are)."""
    c = F.col(f"`{name}`")
    if dtype == "binary":
        return F.hex(c)
    return (c + F.lit(0).cast(dtype) if dtype in ("double", "float") else c).cast("string")


def column_profile(df: DataFrame, exact: bool = True, rsd: float = 0.02) -> DataFrame:
    """Column, Spark type, role and number of distinct values.

    ``exact`` counts distinct (column, value) pairs of one scan: each task turns
    its rows into pairs and keeps each pair once before the shuffle, which no
    frequent value can crowd. Otherwise all columns share one pass of bounded
    sketches with relative error ``rsd``.

    Role: 'id' for string columns named like keys, 'categorical' for other
    string columns, 'numeric' / 'date' / 'other' by type.
    """
    dtypes = dict(df.dtypes)
    if exact:
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _as_key(c, t).alias("v")) for i, (c, t) in enumerate(df.dtypes)])).alias("p"))
        names = F.array(*[F.lit(c) for c in df.columns])
        long = (pairs.select("p.*").where(F.col("v").isNotNull()).distinct().groupBy("i").agg(F.count(F.lit(1)).alias("n")))
        # a column without values has no pair: the names bring it back with 0
        every = df.sparkSession.range(len(df.columns)).select(F.col("id").cast("int").alias("i"))
        long = every.join(F.broadcast(long), "i", "left").select(F.element_at(names, F.col("i") + 1).alias("variable"), F.coalesce("n", F.lit(0)).alias("n_distinct"))
    else:
        agg = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), rsd).alias(c) for c in df.columns])
        long = agg.unpivot([], df.columns, "variable", "n_distinct")

    def role(c, t):
        if t == "string":
            return "id" if c.lower().endswith(("id", "key")) else "categorical"
        if t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal"):
            return "numeric"
        if t in ("date", "timestamp", "timestamp_ntz"):
            return "date"
        return "other"
    spark = df.sparkSession
    meta = spark.createDataFrame([(c, t, role(c, t)) for c, t in dtypes.items()], "variable string, type string, role string")
    return meta.join(long, "variable")
