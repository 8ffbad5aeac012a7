"""Entity x day panel operators: coverage, eligibility, monthly rollups,
annualisation and the filtration audit (AG2, AG16-AG19, AG23).

Day windows are inclusive: days = datediff(end, start) + 1.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_filter(df: DataFrame, date: str, start: str | None, end: str | None) -> DataFrame:
    cond = F.lit(True)
    if start:
        cond = cond & (F.col(date) >= F.lit(start).cast("date"))
    if end:
        cond = cond & (F.col(date) <= F.lit(end).cast("date"))
    return df.where(cond)


def rows_per_entity_day(df: DataFrame, entity: str, date: str) -> DataFrame:
    """(entity, day) -> row count ``_r``: the shared pre-aggregation."""
    return df.groupBy(entity, date).agg(F.count(F.lit(1)).alias("_r"))


def days_per_entity(df: DataFrame, entity: str, date: str, per_day: bool = False) -> DataFrame:
    """Distinct observed days and rows per entity, one scan: pre-aggregated
    on (entity, day) first, so a hot entity is spread over its days.
    ``per_day``: ``df`` already is the (entity, day, _r) pre-aggregation."""
    pd_ = df if per_day else rows_per_entity_day(df, entity, date)
    return pd_.groupBy(entity).agg(F.count(F.lit(1)).alias("n_days"), F.sum("_r").alias("n_rows"))


def coverage(df: DataFrame, entity: str, date: str, start: str | None = None,
             end: str | None = None, per_day: bool = False) -> DataFrame:
    """``(entity, n_days, n_rows, days_in_window, coverage_pct)``.

    Without ``start``/``end`` the window is the data's own first..last day,
    computed as a one-row aggregate joined to every entity row.
    """
    df = window_filter(df, date, start, end)
    per = days_per_entity(df, entity, date, per_day)
    if start and end:
        span = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
        per = per.withColumn("days_in_window", span)
    else:
        bounds = df.agg(F.min(date).alias("_d0"), F.max(date).alias("_d1"))
        lo = F.lit(start).cast("date") if start else F.col("_d0")
        hi = F.lit(end).cast("date") if end else F.col("_d1")
        per = (per.crossJoin(F.broadcast(bounds))
               .withColumn("days_in_window", F.datediff(hi, lo) + 1).drop("_d0", "_d1"))
    return per.withColumn("coverage_pct", F.col("n_days") * 100.0 / F.col("days_in_window"))


def eligible(df: DataFrame, entity: str, date: str, start: str | None, end: str | None,
             min_pct: float) -> DataFrame:
    cov = coverage(df, entity, date, start, end)
    return cov.where(F.col("coverage_pct") >= min_pct)


def day_bitmaps(df: DataFrame, entity: str, date: str) -> DataFrame:
    """``(entity, word, bits)``: the observed days of an entity as 64-day words,
    day number = 64 * word + bit. One partial aggregate; a hot entity is spread
    over its words. Rows without a day leave a word NULL without bits."""
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    bit = F.pmod(day, F.lit(64))
    one = F.coalesce(F.expr("shiftleft(1L, _bit)"), F.lit(0).cast("long"))
    return (df.select(F.col(entity), ((day - bit) / 64).cast("int").alias("word"), bit.cast("int").alias("_bit"))
            .groupBy(entity, "word").agg(F.bit_or(one).alias("bits")))


def _masked(start: str | None, end: str | None) -> Column:
    """The bits of a word that lie inside an inclusive window."""
    first = F.datediff(F.lit(start).cast("date"), F.lit("1970-01-01").cast("date")) - F.col("word") * 64 if start else F.lit(0)
    last = F.datediff(F.lit(end).cast("date"), F.lit("1970-01-01").cast("date")) - F.col("word") * 64 if end else F.lit(63)
    every = F.lit(-1).cast("long")
    low = F.when(first >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", every, F.greatest(first, F.lit(0))))
    high = F.when(last < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", every, F.lit(63) - F.least(last, F.lit(63))))
    return F.col("bits").bitwiseAND(low).bitwiseAND(high)


def coverage_matrix(df: DataFrame, entity: str, date: str, windows: Mapping[str, tuple],
                    thresholds: Sequence[float]) -> DataFrame:
    """Entities reaching each threshold, per named window ``name -> (start, end)``.

    All windows are masked counts over one table of day bitmaps, so a further
    window or threshold costs no further scan or shuffle; per window only the
    counts per number of days (at most the days of the panel) remain. An open
    end is the first or last day that any entity has inside the window.
    """
    spark = df.sparkSession
    names = list(windows)
    words = day_bitmaps(df, entity, date)
    days, firsts, lasts = [], [], []
    for i, (start, end) in enumerate(windows.values()):
        inside = _masked(start, end)
        days.append(F.coalesce(F.sum(F.bit_count(inside)), F.lit(0)).alias(f"d{i}"))
        firsts.append(F.min(F.when(inside != 0, F.col("word") * 64 + F.instr(F.reverse(F.bin(inside)), "1") - 1)).alias(f"f{i}"))
        lasts.append(F.max(F.when(inside != 0, F.col("word") * 64 + F.length(F.bin(inside)) - 1)).alias(f"l{i}"))
    per = words.groupBy(entity).agg(*days, *firsts, *lasts)
    each = per.select(F.explode(F.array(*[F.struct(F.lit(n).alias("window"), F.col(f"d{i}").alias("d"), F.col(f"f{i}").alias("f"),
                                                   F.col(f"l{i}").alias("l")) for i, n in enumerate(names)])).alias("w")).select("w.*")
    bounds = spark.createDataFrame([(n, s, e) for n, (s, e) in windows.items()], "window string, start string, end string")
    counted = (each.groupBy("window", "d").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("f"), F.max("l").alias("l"))
               .groupBy("window").agg(F.collect_list(F.struct("d", "n")).alias("by_days"), F.min("f").alias("f"), F.max("l").alias("l")))

    def number(c: str) -> Column:
        return F.datediff(F.col(c).cast("date"), F.lit("1970-01-01").cast("date"))
    table = F.broadcast(bounds).join(counted, "window", "left").withColumn(
        "days_in_window", (F.coalesce(number("end"), F.col("l")) - F.coalesce(number("start"), F.col("f")) + 1).cast("int"))
    whole = F.col("start").isNull() & F.col("end").isNull()

    def total(keep) -> Column:
        return F.coalesce(F.aggregate("by_days", F.lit(0).cast("long"), lambda t, x: t + F.when(keep(x), x["n"]).otherwise(F.lit(0).cast("long"))),
                          F.lit(0).cast("long"))
    rows = [F.struct(F.lit(float(t)).alias("threshold_pct"),
                     total(lambda x, t=t: ((x["d"] > 0) | whole) & (F.try_divide(x["d"] * 100.0, F.col("days_in_window")) >= t)).alias("n_reaching"))
            for t in thresholds]
    return table.select("window", "days_in_window", total(lambda x: (x["d"] > 0) | whole).alias("n_entities"), F.inline(F.array(*rows)))


def monthly_rollup(df: DataFrame, entity: str, date: str, flag: Column,
                   means: Mapping[str, Column], firsts: Mapping[str, str] | None = None,
                   first_order: Column | None = None) -> DataFrame:
    """Entity x month count table with exposure (AG19).

    ``n_high_days`` = sum of the 0/1 flag, ``n_days`` = rows, means of the
    covariates, the first value of static columns (``firsts``: output name ->
    column, first along ``first_order``, default the day; a ``min_by``
    partial aggregate) and ``log_n_days`` as the offset.
    """
    order = first_order if first_order is not None else F.col(date)
    ym = F.date_format(F.col(date), "yyyy-MM")
    aggs = [F.sum(flag).cast("int").alias("n_high_days"), F.count(F.lit(1)).alias("n_days")]
    aggs += [F.avg(c).alias(n) for n, c in means.items()]
    aggs += [F.min_by(F.col(c), order).alias(n) for n, c in (firsts or {}).items()]
    out = df.groupBy(F.col(entity), ym.alias("year_month")).agg(*aggs)
    return out.withColumn("log_n_days", F.ln(F.col("n_days").cast("double")))


def annualise(df: DataFrame, entity: str, date: str, measure: str, min_months: int = 10) -> DataFrame:
    """Month totals -> per entity-year: months present, total, scaled to 12
    months; years with fewer than ``min_months`` months or a zero total are dropped (AG1+AG2)."""
    monthly = (df.groupBy(entity, F.year(date).alias("year"), F.month(date).alias("month"))
               .agg(F.sum(measure).alias("_m")))
    yearly = monthly.groupBy(entity, "year").agg(
        F.count(F.lit(1)).alias("months_available"),
        F.coalesce(F.sum("_m"), F.lit(0.0)).alias("total"))
    return (yearly.where((F.col("months_available") >= min_months) & (F.col("total") > 0))
            .withColumn("annual_total", F.col("total") * 12 / F.col("months_available")))


def filtration_audit(df: DataFrame, entity: str, date: str, start: str, end: str, min_pct: float,
                     labels: Sequence[str]) -> DataFrame:
    """The whole filtration in one scan: full panel, date window, eligible
    entities, their rows in the window -> ``(step, label, n_entities, n_rows)``.

    Rows are counted per (entity, day), then per entity; a step is a condition
    on that table, so eligibility is computed once."""
    inside = F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    span = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    per = rows_per_entity_day(df, entity, date).groupBy(entity).agg(
        F.sum("_r").alias("_all"), F.coalesce(F.sum(F.when(inside, F.col("_r"))), F.lit(0)).alias("_win"),
        F.count_if(inside).alias("_days"))
    # an entity is counted by its key, so a NULL key is not one; its rows are rows
    known = F.col(entity).isNotNull()
    admitted = (F.col("_days") > 0) & (F.col("_days") * 100.0 / span >= min_pct)
    one = per.agg(F.count_if(known).alias("e0"), F.sum("_all").alias("r0"),
                  F.count_if(known & (F.col("_win") > 0)).alias("e1"), F.sum("_win").alias("r1"),
                  F.count_if(admitted).alias("e2"), F.count_if(admitted & known).alias("e3"),
                  F.coalesce(F.sum(F.when(admitted & known, F.col("_win"))), F.lit(0)).alias("r3"))
    rows = [F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"), F.col(f"e{i}").alias("n_entities"),
                     (F.lit(None).cast("long") if i == 2 else F.coalesce(F.col(f"r{i}"), F.lit(0))).alias("n_rows"))
            for i, label in enumerate(labels)]
    return one.select(F.inline(F.array(*rows)))


def step_audit(steps: Sequence[tuple[str, DataFrame | None, DataFrame | None]], entity: str) -> DataFrame:
    """Filtration audit: per step, entities and rows.

    ``steps`` = (label, row-level frame or None, entity-level frame or None);
    each step is one small aggregate, unioned.
    """
    parts = []
    for i, (label, rows_df, ent_df) in enumerate(steps):
        if rows_df is not None:
            a = rows_df.agg(F.count_distinct(entity).alias("n_entities"),
                            F.count(F.lit(1)).alias("n_rows"))
        else:
            a = ent_df.agg(F.count(F.lit(1)).alias("n_entities"),
                           F.lit(None).cast("long").alias("n_rows"))
        parts.append(a.select(F.lit(i).alias("step"), F.lit(label).alias("label"), "n_entities", "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
