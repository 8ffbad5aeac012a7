"""Exact, skew-safe quantiles (type 7, linear interpolation) per group.

Plain ``percentile`` on rows keeps a value->count map per group and merges
it in one task, so a group holding a third of all rows would land in one
task with all its distinct values.  This operator instead:

1. counts the rows per group; groups of at most ``finish_rows`` rows take
   Spark's exact percentile, whose buffer is then bounded;
2. for larger groups a mergeable sketch (``percentile_approx``, rank error at
   most n / ``SKETCH_ACCURACY``) brackets every target rank between two values;
3. one pass keeps the values inside a bracket, counted per distinct value, and
   adds up everything between brackets, so the ranks are read off exactly from
   a running count over few rows;
4. where a group has more than ``finish_rows`` distinct values inside its
   brackets, they are narrowed by value buckets (equal width, and equal width
   in the logarithm in turn): bucket counts are partial aggregates, the bucket
   holding the rank becomes the new range, until it is small enough;
5. a rank outside its bracket (the sketch's bound excludes it) would send its
   group through step 4 over all its counted values.

Only groups-sized tables and the bracketed counts are materialised, as written
tables in the shared checkpoint folder; nothing groups-sized reaches the driver.
``method='approx'`` switches to ``percentile_approx`` (bounded sketch, no
interpolation); ``method='grouped'`` is Spark's own exact percentile, for groups
that are small by construction (the years of an entity, say).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.operators.joins import null_safe_join

#: rows, or distinct values, that one group's buffer or window may hold
FINISH_ROWS = 20_000
#: samples of a group's sketch; its rank error is at most n over this
SKETCH_ACCURACY = 2000
#: group-sized sides of up to so many rows are broadcast (a few MB)
BROADCAST_GROUPS = 50_000
N_BUCKETS = 1024
#: doubles have 2**64 values, so two rounds in three digits each suffice many times over
MAX_LEVELS = 200


def prob_label(p: float) -> str:
    s = f"{p:.6f}".rstrip("0").rstrip(".")
    return "q" + s.replace("0.", "").replace(".", "_") if p < 1 else "q100"


def quantiles_long(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                   method: str = "exact", accuracy: int = 10000,
                   finish_rows: int = FINISH_ROWS, n_buckets: int = N_BUCKETS) -> DataFrame:
    """Return ``(by..., prob DOUBLE, quantile DOUBLE)``; NULL/NaN values ignored."""
    by = list(by)
    base = (df.select(*by, F.col(value).cast("double").alias("_v"))
            .where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    probs = [float(p) for p in probs]
    if method == "approx":
        agg = base.groupBy(*by).agg(
            F.percentile_approx("_v", F.array(*[F.lit(p) for p in probs]), accuracy).alias("_qs"))
        return agg.select(*by, F.posexplode("_qs").alias("_i", "quantile")).select(
            *by, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1).alias("prob"),
            "quantile")
    if method == "grouped":
        agg = base.groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(p) for p in probs])).alias("_qs"))
        return agg.select(*by, F.posexplode("_qs").alias("_i", "quantile")).select(
            *by, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1).alias("prob"), "quantile")
    sizes = _written(base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "q_sizes")
    n_groups, most = sizes.agg(F.count(F.lit(1)), F.max("_n")).first()
    if n_groups == 0 or most <= finish_rows:
        return _written(_direct(base, probs, by), "quantiles")
    if by:
        large = sizes.where(F.col("_n") > finish_rows).drop("_n")
        n_large = large.count()
        # one row per large group: at most a finish_rows-th of the rows, sent whole only when few
        side = F.broadcast(large) if n_large <= BROADCAST_GROUPS else large
        big = null_safe_join(base, side, by, "left_semi")
        out = _bracketed(big, n_large, probs, by, finish_rows, n_buckets)
        if n_large < n_groups:
            out = out.unionByName(_direct(null_safe_join(base, side, by, "left_anti"), probs, by))
    else:
        out = _bracketed(base, 1, probs, by, finish_rows, n_buckets)
    # groups x probs rows: written once, so that readers do not compute it again
    return _written(out, "quantiles")


def _direct(base: DataFrame, probs: list[float], by: list[str]) -> DataFrame:
    """Spark's exact percentile, for groups of bounded rows."""
    parr = F.array(*[F.lit(p) for p in probs])
    agg = base.groupBy(*by).agg(F.percentile("_v", parr).alias("_qs"))
    return agg.select(*by, F.posexplode("_qs").alias("_i", "quantile")).select(*by, F.element_at(parr, F.col("_i") + 1).alias("prob"), "quantile")


def _bracketed(base: DataFrame, n_groups: int, probs: list[float], by: list[str], finish_rows: int, n_buckets: int) -> DataFrame:
    """Quantiles of large groups: sketch, one counting pass, exact ranks."""
    spark = base.sparkSession
    # more than the sketch's error, by at least a few ranks in groups of over finish_rows rows
    slack = 2.0 / SKETCH_ACCURACY + 3.0 / finish_rows
    ends = [e for p in probs for e in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = F.percentile_approx("_v", F.array(*[F.lit(e) for e in ends]), SKETCH_ACCURACY)
    marks = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch.alias("_e"))
    marks = _written(marks.where("_n > 0"), "q_marks")
    # a bracket that reaches an end of the order takes the end itself, which the sketch may miss
    lo = [F.col("_min") if ends[2 * j] == 0 else F.col("_e")[2 * j] for j in range(len(probs))]
    hi = [F.col("_max") if ends[2 * j + 1] == 1 else F.col("_e")[2 * j + 1] for j in range(len(probs))]
    lo_hi = marks.select(*by, F.array(*lo).alias("_lo"), F.array(*hi).alias("_hi"))
    side = F.broadcast(lo_hi) if n_groups <= BROADCAST_GROUPS else lo_hi
    rows = null_safe_join(base, side, by, "inner") if by else base.crossJoin(F.broadcast(lo_hi))
    inside, gap = F.lit(False), F.lit(0)
    for j in range(len(probs)):
        inside = inside | ((F.col("_v") >= F.col("_lo")[j]) & (F.col("_v") <= F.col("_hi")[j]))
        gap = gap + (F.col("_v") > F.col("_hi")[j]).cast("int")
    # a bracketed value counts for itself, the values between two brackets count together
    counted = _written(rows.groupBy(*by, F.when(inside, F.col("_v")).alias("_x"), F.when(~inside, gap).alias("_gap"))
                       .agg(F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_v")).drop("_x"), "q_counted")
    sizes = _written(counted.groupBy(*by).agg(F.count(F.lit(1)).alias("_nd"), F.sum("_c").alias("_n"), F.min("_v").alias("_lo"),
                                              F.max("_v").alias("_hi")), "q_stats")
    if sizes.where(F.col("_nd") > finish_rows).limit(1).count() == 0:
        found = _read_ranks(spark, counted, sizes, probs, by)
    else:
        few = null_safe_join(counted, sizes.where(F.col("_nd") <= finish_rows).select(*by), by, "left_semi") if by else counted.limit(0)
        found = _read_ranks(spark, few, sizes.where(F.col("_nd") <= finish_rows), probs, by).unionByName(
            _large_groups(spark, counted.select(*by, "_v", "_c"), sizes.where(F.col("_nd") > finish_rows), probs, by, finish_rows, n_buckets)
            .withColumn("_missed", F.lit(False)))
    found = _written(found, "q_found")
    if found.where("_missed").limit(1).count() == 0:
        return found.drop("_missed")
    lost = found.where("_missed").select(*by).distinct()
    again = null_safe_join(base, lost, by, "left_semi") if by else base
    vc = _written(again.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")), "q_values")
    stats = vc.groupBy(*by).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_nd"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    kept = null_safe_join(found, lost, by, "left_anti") if by else found.limit(0)
    return kept.drop("_missed").unionByName(_large_groups(spark, vc, _written(stats, "q_stats"), probs, by, finish_rows, n_buckets))


def _read_ranks(spark, counted: DataFrame, sizes: DataFrame, probs: list[float], by: list[str]) -> DataFrame:
    """(by..., prob, quantile, _missed) off a running count of at most
    ``finish_rows`` rows per group; a rank on a row of several values is missed."""
    w = Window.partitionBy(*by).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cum = counted.withColumn("_cum", F.sum("_c").over(w))
    n = sizes.select(*by, "_n")
    cum = null_safe_join(cum, n, by, "inner") if by else cum.crossJoin(F.broadcast(n))
    targets = F.array(*[F.struct(F.lit(p).alias("prob"), ((F.col("_n") - 1) * F.lit(p)).alias("h")) for p in probs])
    # the two ranks around each target that this row holds
    hit = cum.withColumn("_t", F.explode(targets)).select(
        *by, F.col("_t.prob").alias("prob"), F.col("_t.h").alias("_h"), "_v", "_gap", (F.col("_cum") - F.col("_c")).alias("_from"), "_cum")
    low, high = F.floor("_h"), F.ceil("_h")
    on_low, on_high = (low >= F.col("_from")) & (low < F.col("_cum")), (high >= F.col("_from")) & (high < F.col("_cum"))
    hit = hit.where(on_low | on_high)
    v_low, v_high = F.max(F.when(on_low, F.col("_v"))), F.max(F.when(on_high, F.col("_v")))
    return hit.groupBy(*by, "prob").agg(
        (v_low + (v_high - v_low) * (F.max("_h") - F.floor(F.max("_h")))).alias("quantile"), F.max(F.col("_gap").isNotNull()).alias("_missed"))


def _large_groups(spark, vc: DataFrame, stats: DataFrame, probs, by: list[str], finish_rows: int,
                  n_buckets: int) -> DataFrame:
    """Groups with more than ``finish_rows`` distinct values: narrow each
    target rank's value range by bucket counts until it is small, then read
    the rank off a bounded cumulative count; interpolate type 7."""
    pr = spark.createDataFrame([(i, p) for i, p in enumerate(probs)], "_pi int, prob double")
    tgt = (stats.crossJoin(F.broadcast(pr))
           .withColumn("_h", (F.col("_n") - 1) * F.col("prob"))
           .withColumn("_rlo", F.floor("_h").cast("long"))
           .withColumn("_rhi", F.ceil("_h").cast("long"))
           .withColumn("_frac", F.col("_h") - F.col("_rlo")))
    state = (tgt.select(*by, F.explode(F.array_distinct(F.array("_rlo", "_rhi"))).alias("_r"),
                        "_lo", "_hi", "_nd")
             .distinct().withColumn("_base", F.lit(0).cast("long")))
    parts = []
    for level in range(MAX_LEVELS):
        parts.append(_finish(vc, state.where(F.col("_nd") <= finish_rows), by))
        rest = state.where(F.col("_nd") > finish_rows)
        if rest.limit(1).count() == 0:
            break
        state = _written(_refine(vc, rest, by, n_buckets, logarithmic=level % 2 == 1), "q_state")
    else:
        raise RuntimeError("quantile ranges did not narrow")
    answers = parts[0]
    for a in parts[1:]:
        answers = answers.unionByName(a)
    lo = answers.withColumnRenamed("_r", "_rlo").withColumnRenamed("_ans", "_vlo")
    hi = answers.withColumnRenamed("_r", "_rhi").withColumnRenamed("_ans", "_vhi")
    return (null_safe_join(null_safe_join(tgt.select(*by, "prob", "_rlo", "_rhi", "_frac"), lo, [*by, "_rlo"], "left"),
                    hi, [*by, "_rhi"], "left")
            .select(*by, "prob", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac"))
                    .alias("quantile")))


def _written(df: DataFrame, name: str) -> DataFrame:
    """Materialise a target-sized table in the shared checkpoint folder."""
    from panelkit.sources.io import checkpoint_table
    return checkpoint_table(df, name)


def _join_candidates(vc: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    cond = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    if by:
        return null_safe_join(vc, ranges, by, "inner").where(cond)
    return vc.crossJoin(F.broadcast(ranges)).where(cond)


_RANGE = ["_lo", "_hi", "_base"]


def _finish(vc: DataFrame, state: DataFrame, by: list[str]) -> DataFrame:
    """Exact ranks inside small ranges: one cumulative count per distinct
    search range (shared by all target ranks in it), then a rank lookup."""
    ranges = state.select(*by, *_RANGE).distinct()
    cand = _join_candidates(vc, ranges, by)
    w = Window.partitionBy(*by, *_RANGE).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    cum = cand.withColumn("_cum", F.col("_base") + F.sum("_c").over(w))
    hit = (F.col("_cum") - F.col("_c") <= F.col("_r")) & (F.col("_r") < F.col("_cum"))
    return (null_safe_join(cum, state.select(*by, *_RANGE, "_r"), [*by, *_RANGE], "inner").where(hit)
            .select(*by, "_r", F.col("_v").alias("_ans")))


def _refine(vc: DataFrame, state: DataFrame, by: list[str], n_buckets: int, logarithmic: bool = False) -> DataFrame:
    """Narrow every large range to the value bucket holding each target rank
    (bucket counts are partial aggregates, <= n_buckets rows per range)."""
    ranges = state.select(*by, *_RANGE).distinct()
    cand = _join_candidates(vc, ranges, by)
    at = (lambda c: F.signum(c) * (F.ln(F.abs(F.col(c)) + 1e-300) + 691.0)) if logarithmic else F.col
    width = at("_hi") - at("_lo")
    bucket = F.when(width > 0, F.least(F.floor((at("_v") - at("_lo")) / width * n_buckets),
                                       F.lit(n_buckets - 1))).otherwise(F.lit(0)).cast("int")
    bk = (cand.withColumn("_b", bucket)
          .groupBy(*by, *_RANGE, "_b")
          .agg(F.sum("_c").alias("_bc"), F.count(F.lit(1)).alias("_bnd"),
               F.min("_v").alias("_bmin"), F.max("_v").alias("_bmax")))
    w = Window.partitionBy(*by, *_RANGE).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    bk = bk.withColumn("_cum", F.col("_base") + F.sum("_bc").over(w))
    hit = (F.col("_cum") - F.col("_bc") <= F.col("_r")) & (F.col("_r") < F.col("_cum"))
    return (null_safe_join(bk, state.select(*by, *_RANGE, "_r"), [*by, *_RANGE], "inner").where(hit)
            .select(*by, "_r", F.col("_bmin").alias("_lo"), F.col("_bmax").alias("_hi"),
                    F.col("_bnd").alias("_nd"), (F.col("_cum") - F.col("_bc")).alias("_base")))


def quantiles_wide(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                   names: Sequence[str] | None = None, **kw) -> DataFrame:
    """One row per group with one column per probability."""
    by = list(by)
    names = list(names) if names else [prob_label(p) for p in probs]
    long = quantiles_long(df, value, probs, by, **kw)
    cols = [F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(n)
            for p, n in zip(probs, names)]
    if by:
        return long.groupBy(*by).agg(*cols)
    return long.agg(*cols)


def median(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "median", **kw) -> DataFrame:
    return quantiles_wide(df, value, [0.5], by, [name], **kw)
