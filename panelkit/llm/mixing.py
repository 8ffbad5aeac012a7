"""Mixing sources to target weights by entropy balancing.

Targets. Sources in code-point order (null last) weigh 1, 2, 3, repeating, and
share the words of the whole table by weight; no target passes three times its
source's words, what is over is shared out again by weight. That is the level
theta with sum(min(3 S, theta w)) = total, found by one ordered pass over the
sources.

Rates. Per source the document rates r_i closest to 1 in Kullback-Leibler
distance that meet the token constraint sum(r_i size_i) = target are
exponentially tilted: r_i = min(3, exp(lambda size_i / mean size)). The dual is
one-dimensional and convex; Newton steps on the logarithm of the constraint,
held inside a bracket, solve it for all sources at once. Each step is one
aggregate over (source, size, documents) counts, never over the texts.

Copies. floor(r_i) copies, then one more for some documents: in the order of a
fixed hash over the fraction, documents are taken while the source's words left
to its target allow it, and the remainder is offered again to the smaller ones.
The running sums go over blocks of that order, cut by range partitioning of
sources and order, so no task holds a source and none holds a crowded stretch
of it. At last the one document whose size is nearest to what is still missing is taken
if that comes nearer to the target.

Only DataFrame operations are used. Defined results: a null or blank text has
size 0 and takes 0 words (its rate is 1); a null source is a source of its own,
ranked last; rows with equal id, source and text are decided alike (a null id is
one id, its texts are told apart); empty
tables give empty results; reruns agree, as everything follows from the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import maybe_broadcast, task_count, text_or_empty, written

WORD = r"[^\x20\x09-\x0D]+"
MAX_RATE = 3
MAX_STEPS = 40
TOLERANCE = 1e-4
#: rows per block of the running sums: as few as BLOCK_ROWS while that gives
#: less than BLOCKS_PER_TASK blocks a shuffle partition, at most MAX_BLOCK_ROWS
BLOCK_ROWS = 4000
BLOCKS_PER_TASK = 8
MAX_BLOCK_ROWS = 1_000_000
#: times the words left over are offered again
FILL_PASSES = 4


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def with_targets(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size, ...) with weight and target."""
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(MAX_RATE)).withColumn("ratio", F.col("cap") / F.col("weight"))
    total = F.sum("source_size").over(every)
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    cap_before = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_from = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # the level if exactly the sources before this one were at their caps; the
    # true level is the first one that its own source's cap does not undercut
    leveled = ranked.withColumn("level", (total - cap_before) / weight_from)
    theta = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.sum("weight").over(upto).alias("o"), F.col("level").alias("v")))).over(every)
    out = leveled.withColumn("theta", theta["v"])
    return out.withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("theta") * F.col("weight"), F.col("cap")))) \
        .drop("cap", "ratio", "level", "theta")


def _rate(lam: Column, size: Column, mean: Column) -> Column:
    """min(3, exp(lambda size / mean)); lambda null means the cap is met."""
    power = F.least(F.lit(50.0), lam * size / mean)
    return F.when(lam.isNull(), F.lit(float(MAX_RATE))).otherwise(F.least(F.lit(float(MAX_RATE)), F.exp(power)))


def solve_rates(sizes: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """lambda per source: Newton on log(sum of rate x size) - log(target)."""
    target, size = F.col("target"), F.col("source_size")
    full = target >= size * (MAX_RATE * (1 - 1e-9))
    state = sources.withColumn("lam", F.when(full | (size == 0), None).otherwise(F.log(target / size))) \
        .withColumn("lo", F.lit(-1e6)).withColumn("hi", F.lit(1e6)).withColumn("off", F.lit(1.0))
    state = written(state, "dual")
    for _ in range(MAX_STEPS):
        side = maybe_broadcast(state.filter("lam is not null"), 120, n_sources)
        joined = sizes.join(side, sizes["source"].eqNullSafe(side["source"])).select(
            side["source"], "size", "n", "lam", "mean")
        rate = _rate(F.col("lam"), F.col("size"), F.col("mean"))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < MAX_RATE, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = joined.groupBy("source").agg(F.sum(words).alias("g"), F.sum(slope).alias("dg"))
        s = state.join(maybe_broadcast(sums, 60, n_sources), state["source"].eqNullSafe(sums["source"]), "left") \
            .select(state["*"], "g", "dg")
        over = F.col("g") > target
        s = s.withColumn("lo", F.when(~over, F.col("lam")).otherwise(F.col("lo"))) \
             .withColumn("hi", F.when(over, F.col("lam")).otherwise(F.col("hi")))
        step = F.col("lam") - (F.log("g") - F.log(target)) * F.col("g") / F.when(F.col("dg") > 0, F.col("dg"))
        inside = (step > F.col("lo")) & (step < F.col("hi"))
        middle = F.when(F.col("hi") >= 1e6, F.greatest(F.lit(1.0), F.col("lam") * 2)) \
            .when(F.col("lo") <= -1e6, F.least(F.lit(-1.0), F.col("lam") * 2)).otherwise((F.col("lo") + F.col("hi")) / 2)
        off = F.coalesce(F.abs(F.col("g") / target - 1), F.lit(0.0))
        s = s.withColumn("off", off).withColumn("next", F.when(inside, step).otherwise(middle))
        s = s.withColumn("lam", F.when(F.col("off") > TOLERANCE, F.col("next")).otherwise(F.col("lam"))).drop("g", "dg", "next")
        state = written(s, "dual")
        if (state.agg(F.max("off")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select("source", "lam")


def _fill(rows: DataFrame, n_sources: int, n_rows: int) -> DataFrame:
    """One pass: give one more copy, in the order of ``turn``, to documents that
    are no larger than the words left of their source and whose running sum
    stays within them. Documents that got one come later the next time."""
    taken = rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("used"), F.first("target").alias("t"),
                                       F.count(F.lit(1)).alias("rows_"))
    room = taken.select(F.col("source").alias("rs"), (F.col("t") - F.col("used")).alias("room"))
    joined = rows.join(maybe_broadcast(written(room, "room"), 60, n_sources), F.col("source").eqNullSafe(F.col("rs"))).drop("rs")
    open_ = (F.col("copies") < MAX_RATE) & (F.col("size") > 0) & (F.col("size") <= F.col("room"))
    order = ["turn", "doc_id", "size", "mark"]
    blocks = max(n_rows // MAX_BLOCK_ROWS, min(BLOCKS_PER_TASK * task_count(rows.sparkSession), n_rows // BLOCK_ROWS)) + 1
    dealt = written(joined.filter(open_).repartitionByRange(blocks, "source", *order).withColumn("block", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("os"), F.col("block").alias("ob"),
                          F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "block").orderBy(*order)
    offered = (dealt.join(offsets, F.col("source").eqNullSafe(F.col("os")) & (F.col("block") == F.col("ob")))
               .withColumn("upto", F.sum("size").over(inside) + F.col("offset")))
    yes = F.col("upto") <= F.col("room")
    # one select: both columns are set from the same comparison
    offered = offered.withColumn("copies", F.col("copies") + yes.cast("long")).withColumn("turn", F.when(yes, 0.5 + F.col("turn") / 2).otherwise(F.col("turn")))
    return written(offered.select(*rows.columns).unionByName(joined.filter(~open_).select(*rows.columns)), "fill")


def _nearest(rows: DataFrame, n_sources: int) -> DataFrame:
    """One more copy of the document nearest in size to its source's words left."""
    room = rows.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("room")) \
        .withColumnRenamed("source", "rs")
    side = maybe_broadcast(room, 60, n_sources)
    helps = (F.col("copies") < MAX_RATE) & (F.col("size") > 0) & (F.abs(F.col("room") - F.col("size")) < F.col("room"))
    best = (rows.join(side, F.col("source").eqNullSafe(F.col("rs"))).filter(helps).groupBy("source")
            .agg(F.min(F.struct(F.abs(F.col("room") - F.col("size")).alias("off"), "turn", "doc_id", "size", "mark")).alias("b"))
            .select(F.col("source").alias("bs"), F.col("b.doc_id").alias("bi"), F.col("b.size").alias("bz"), F.col("b.mark").alias("bm")))
    chosen = maybe_broadcast(written(best, "nearest"), 60, n_sources)
    same = F.col("source").eqNullSafe(F.col("bs")) & F.col("doc_id").eqNullSafe(F.col("bi")) & (F.col("size") == F.col("bz")) & (F.col("mark") == F.col("bm"))
    return (rows.join(chosen, same, "left")
            .withColumn("copies", F.col("copies") + F.col("bz").isNotNull().cast("long")).select(*rows.columns))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, mark (the text's 64-bit hash), source_size, target,
    rate, copies, taken per row."""
    base = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_or_empty(text_col)).alias("size"),
                               F.xxhash64(text_or_empty(text_col)).alias("mark")), "sizes")
    sizes = written(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size_counts")
    totals = sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    totals = totals.withColumn("mean", F.greatest(F.lit(1.0), F.col("source_size") / F.col("docs")))
    sources = written(with_targets(totals), "targets")
    n_sources = sources.count()
    rates = solve_rates(sizes, sources, n_sources)
    solved = sources.join(rates, sources["source"].eqNullSafe(rates["source"])).select(
        sources["source"].alias("ss"), "source_size", "mean", "target", "lam")
    rows = base.join(maybe_broadcast(solved, 120, n_sources), F.col("source").eqNullSafe(F.col("ss")))
    rate = F.when(F.col("source_size") == 0, F.lit(1.0)).otherwise(_rate(F.col("lam"), F.col("size"), F.col("mean")))
    rows = rows.withColumn("rate", rate).withColumn("copies", F.floor("rate").cast("long"))
    part = F.col("rate") - F.col("copies")
    key = F.when(F.col("doc_id").isNull(), F.xxhash64("mark", F.lit(17))).otherwise(F.xxhash64("doc_id", "size", F.lit(17)))
    chance = (F.pmod(key, F.lit(1 << 40)) + 0.5) / float(1 << 40)
    # monotone in chance / part: documents that independent rounding would copy come first
    rows = rows.withColumn("turn", chance / (chance + part))
    rows = written(rows.select("doc_id", "source", "size", "mark", "source_size", "target", "rate", "copies", "turn"), "rates")
    n_rows = rows.count()
    for _ in range(FILL_PASSES):
        rows = _fill(rows, n_sources, n_rows)
    rows = _nearest(rows, n_sources)
    return rows.withColumn("taken", F.col("copies") * F.col("size")).select(
        "doc_id", "source", "size", "mark", "source_size", "target", "rate", "copies", "taken")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, unchanged."""
    decided = mix(docs, id_col, text_col, source_col)
    counts = decided.groupBy("doc_id", "source", "size", "mark").agg(F.max("copies").alias("_copies")) \
        .select(F.col("doc_id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("mark").alias("_m"), "_copies")
    counts = written(counts.filter("_copies > 0"), "copies")
    side = maybe_broadcast(counts, 70)
    sized = docs.withColumns({"_size": word_count(text_or_empty(text_col)), "_mark": F.xxhash64(text_or_empty(text_col))})
    joined = sized.join(side, sized[id_col].eqNullSafe(side["_i"]) & sized[source_col].eqNullSafe(side["_s"]) & (sized["_size"] == side["_z"])
                        & (sized["_mark"] == side["_m"]))
    return joined.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*docs.columns)
