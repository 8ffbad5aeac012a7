"""Distributed running sums along a total order without a single-partition window.

A global ``Window.orderBy`` sends every row to one task.  Here the order is
cut into *blocks* (an integer column that never decreases along the order):
block totals form a small table (<= number of blocks per group) whose prefix
sums are the block offsets; a second window only runs inside one block.
Blocks come either from leading hex digits of an md5 order key (uniform by
construction) or from Spark's own range partitioning of the whole order
(values *and* tie keys, so equal values spread over blocks too).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelkit.operators.joins import null_safe_join

#: blocks per shuffle partition for hash orders
BLOCKS_PER_PARTITION = 8
#: at most 16**5 block offsets (16 MB) are ever broadcast
MAX_HEX_DIGITS = 5
ROWS_PER_BLOCK = 1_000_000


def hex_digits(spark: SparkSession) -> int:
    """Leading hex digits that give several blocks per shuffle partition: the
    block count follows the partitioning the session is sized for."""
    want = BLOCKS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_HEX_DIGITS, max(1, math.ceil(math.log(want, 16))))


def hex_block(hex_col, digits: int) -> Column:
    """Block id from the first ``digits`` hex characters (16**digits blocks)."""
    c = F.col(hex_col) if isinstance(hex_col, str) else hex_col
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("int")


def with_range_blocks(df: DataFrame, order: Sequence[Column], out: str = "_blk",
                      rows_per_block: int = ROWS_PER_BLOCK, n_rows: int | None = None) -> DataFrame:
    """Range-partition the rows along ``order`` (a total order) and add the
    partition number as the block column.  The result is written once, so the
    blocks cannot change between reads.  NULLs are placed by the order itself."""
    from panelkit.sources.io import checkpoint_table
    n = df.count() if n_rows is None else n_rows
    blocks = int(n // rows_per_block + 1)
    dealt = df.repartitionByRange(blocks, *order).withColumn(out, F.spark_partition_id())
    return checkpoint_table(dealt, "range_blocks")


def running_sums(df: DataFrame, order: Sequence[Column], values: Mapping[str, Column], block: Column,
                 partition_by: Sequence[str] = (), exclusive: bool = False,
                 totals: Mapping[str, str] | None = None) -> DataFrame:
    """Add each ``out`` of ``values`` = sum of its column over rows up to this
    one along ``order``; all sums share one window and one join.

    ``order`` must be a total order (add a tiebreak key), ``block`` must not
    decrease along it.  With ``partition_by`` the sums restart per group (a
    NULL key is a group).  ``exclusive`` excludes the current row.  ``totals``
    maps an ``out`` to a column name for its sum over the whole group.
    """
    by, outs = list(partition_by), list(values)
    tmp = df.withColumns({"_pk_blk": block, **{f"_pk_v{i}": values[o] for i, o in enumerate(outs)}})
    sums = tmp.groupBy(*by, "_pk_blk").agg(*[F.sum(f"_pk_v{i}").alias(f"_pk_b{i}") for i in range(len(outs))])
    before = Window.partitionBy(*by).orderBy("_pk_blk").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.coalesce(F.sum(f"_pk_b{outs.index(o)}").over(Window.partitionBy(*by)), F.lit(0)).alias(name)
             for o, name in (totals or {}).items()]
    offsets = sums.select(*by, "_pk_blk", *extra, *[
        F.coalesce(F.sum(f"_pk_b{i}").over(before), F.lit(0)).alias(f"_pk_o{i}") for i in range(len(outs))])
    # without groups there are at most as many offsets as blocks
    joined = null_safe_join(tmp, offsets if by else F.broadcast(offsets), [*by, "_pk_blk"])
    inside = Window.partitionBy(*by, "_pk_blk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    out = joined.withColumns({o: F.col(f"_pk_o{i}") + F.coalesce(F.sum(f"_pk_v{i}").over(inside), F.lit(0))
                              for i, o in enumerate(outs)})
    return out.drop("_pk_blk", *[f"_pk_{k}{i}" for i in range(len(outs)) for k in ("v", "o")])


def running_sum(df: DataFrame, order: Sequence[Column], value: Column, block: Column, out: str,
                partition_by: Sequence[str] = (), exclusive: bool = False) -> DataFrame:
    """Add ``out`` = sum of ``value`` over rows up to this one along ``order``."""
    return running_sums(df, order, {out: value}, block, partition_by, exclusive)


def row_rank(df: DataFrame, order: Sequence[Column], block: Column, out: str,
             partition_by: Sequence[str] = ()) -> DataFrame:
    """1-based position along ``order`` (within ``partition_by``), block-parallel."""
    return running_sum(df, order, F.lit(1).cast("long"), block, out, partition_by)
