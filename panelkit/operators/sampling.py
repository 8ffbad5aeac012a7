"""Reproducible sampling and splitting by hash order (SP1-SP5, WN1, WN2).

R's random streams cannot be reproduced; a seed becomes a hash salt:
``md5(concat_ws('#', key..., seed))`` gives every row a fixed pseudo-random
position that any engine can recompute.  Ranks and running sums along that
order are block-parallel (see ``prefix``): the first hex digits of the md5
are the block, so no step sends all rows through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.operators.prefix import hex_block, hex_digits, running_sum, running_sums, with_range_blocks


#: samples up to this size are taken by a top-k
TOP_K_ROWS = 100_000


def hash_key(keys: Sequence[str], seed) -> Column:
    return F.md5(F.concat_ws("#", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_int32(h: Column) -> Column:
    """First 8 hex digits of the hash as a non-negative integer (< 2**32)."""
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def kfold(df: DataFrame, keys: Sequence[str], k: int, seed=42, out: str = "fold") -> DataFrame:
    return df.withColumn(out, F.pmod(hash_int32(hash_key(keys, seed)), F.lit(k)).cast("int"))


def split_hash(df: DataFrame, keys: Sequence[str], frac: float, seed=42,
               out: str = "is_train") -> DataFrame:
    """Scalable approximate split: hash position below ``frac`` of 2**32."""
    thr = int(frac * 2 ** 32)
    return df.withColumn(out, (hash_int32(hash_key(keys, seed)) < F.lit(thr)).cast("int"))


def hash_rank(df: DataFrame, keys: Sequence[str], seed=42, by: Sequence[str] = (),
              out: str = "_rank", digits: int | None = None, size: str | None = None) -> DataFrame:
    """1-based position along the hash order (within ``by``), block-parallel;
    ``size`` names a column for the group's row count (from the same block
    totals, so it costs no further scan)."""
    h = hash_key(keys, seed)
    tmp = df.withColumn("_h", h)
    blocks = hex_block("_h", digits or hex_digits(df.sparkSession))
    ranked = running_sums(tmp, [F.col("_h"), *[F.col(k) for k in keys]], {out: F.lit(1).cast("long")},
                          blocks, partition_by=list(by), totals={out: size} if size else None)
    return ranked.drop("_h")


def split_exact(df: DataFrame, keys: Sequence[str], frac: float, seed=42, by: Sequence[str] = (),
                out: str = "is_train", rounding: str = "floor") -> DataFrame:
    """Exact-size split: the first floor(frac*n) (or ceil, per stratum) rows of
    the hash order are train.  A NULL stratum is a stratum."""
    ranked = hash_rank(df, keys, seed, list(by), size="_n")
    rnd = F.floor if rounding == "floor" else F.ceil
    cut = rnd(F.col("_n") * F.lit(frac))
    return ranked.withColumn(out, (F.col("_rank") <= cut).cast("int")).drop("_rank", "_n")


def sample_n(df: DataFrame, keys: Sequence[str], n: int, seed=42) -> DataFrame:
    """Exact-n sample: the n smallest hash positions.  A small n is a top-k; a
    large one is read off the block-parallel rank, with the same rows."""
    if n > TOP_K_ROWS:
        return hash_rank(df, keys, seed).where(F.col("_rank") <= n).drop("_rank")
    h = hash_key(keys, seed)
    return df.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h")


def budget_admit(entities: DataFrame, key: str, size: str, cap: int, seed=42,
                 order: str = "random", materialize: bool = True) -> DataFrame:
    """Row-budget admission over an entity table (one row per entity).

    Entities are taken in hash order (``order='random'``) or by descending
    size (``'largest'``, ties by key); an entity is admitted while the
    running total of ``size`` stays <= ``cap``.  Returns the entity rows with
    ``cumulative_rows`` for the admitted ones.  The entity table is read twice
    (block totals and the in-block running sum), so by default it is first
    written once to the shared checkpoint folder (one row per entity).
    """
    if materialize:
        from panelkit.sources.io import checkpoint_table
        entities = checkpoint_table(entities, "budget_entities")
    if order == "random":
        tmp = entities.withColumn("_h", hash_key([key], seed))
        out = running_sum(tmp, [F.col("_h"), F.col(key)], F.col(size).cast("long"),
                          hex_block("_h", hex_digits(entities.sparkSession)), "cumulative_rows").drop("_h")
    else:
        by_size = [F.col(size).desc_nulls_last(), F.col(key)]
        ent = with_range_blocks(entities, by_size, "_sblk")
        out = running_sum(ent, by_size, F.col(size).cast("long"), F.col("_sblk"), "cumulative_rows").drop("_sblk")
    return out.where(F.col("cumulative_rows") <= cap)


def prefix_summary(admitted: DataFrame, size: str) -> DataFrame:
    """Size and mean of the admitted prefix (one row)."""
    return admitted.agg(F.count(F.lit(1)).alias("n_entities"), F.sum(size).alias("n_rows"),
                        F.avg(size).alias("mean_size"))


__all__ = ["hash_key", "kfold", "split_hash", "split_exact", "sample_n", "budget_admit",
           "prefix_summary", "hash_rank"]
