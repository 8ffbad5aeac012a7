"""Helpers shared by the operators of this subpackage: intermediate tables in
the shared checkpoint folder, size-checked broadcasts and key arithmetic."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.session import checkpoint_dir

#: a side is broadcast only when its counted rows times this many bytes stay below the limit
BROADCAST_LIMIT_BYTES = 48 << 20

_WRITTEN: list[str] = []


#: rows of whole texts that go to a Python worker at a time
ROWS_PER_BATCH = 2000


def prepare(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it (a
    cluster's executors have it installed or get it with --py-files), and keep
    their batches small, as rows hold whole texts."""
    per_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(per_batch)) > ROWS_PER_BATCH:
        spark.conf.set(per_batch, str(ROWS_PER_BATCH))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, label: str = "t", **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) into the shared checkpoint folder and read it back.

    This cuts the lineage at storage every executor sees, so a lost executor
    costs at most the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables ``written`` has made in this session; returns how many.

    Call it once the results that read them have been stored elsewhere.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def maybe_broadcast(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """``broadcast(df)`` when its counted size is within the limit, else ``df``
    itself: the join is then a shuffled one with the same rows."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_LIMIT_BYTES else df


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def task_count(spark: SparkSession, floor: int = 1) -> int:
    return max(floor, int(spark.conf.get("spark.sql.shuffle.partitions")))
