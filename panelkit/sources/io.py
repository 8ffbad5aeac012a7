"""Sources and sinks (IO1-IO6).

``read_delimited_dir`` reads a directory of per-entity delimited files into
one all-text table, binding columns **by name** even when files order their
headers differently (Spark's CSV reader binds by position).  Plain files on a
path that executors mount are one scan of the data source in ``by_name.py``.
Elsewhere (storage only Spark's readers open, compressed files) files are
grouped by header, each group is read with a schema in its own column order,
and the groups are unioned by name.  A file whose header lacks a key column
stops the read with its name; empty files contribute nothing.  The driver
holds one path per file, as Spark's own file index does.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import defaultdict
from collections.abc import Mapping, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.models import persist
from panelkit.session import checkpoint_dir
from panelkit.sources import by_name

#: endings that Spark's readers decompress
COMPRESSED = (".gz", ".gzip", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")


def _string_schema(cols: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in cols])


def _escaped(path: str) -> str:
    """A literal path for readers that take globs."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def file_headers(spark: SparkSession, path: str, sep: str, key_columns: Sequence[str],
                 glob: str = "*.csv") -> dict[str, list[str]]:
    """Header line -> files.  While the heads are read every split is a task of
    its own, and a task stops after its first batch of lines, so the files are
    not scanned."""
    lines = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")))

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                if batch.column(2)[0].as_py() == 0:
                    yield batch.slice(0, 1).select(["value", "file"])
                return

    own_task = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(own_task)
    spark.conf.set(own_task, str(1 << 40))
    try:
        heads = lines.mapInArrow(first, "value string, file string").collect()
    finally:
        spark.conf.set(own_task, before)
    groups: dict[str, list[str]] = defaultdict(list)
    for r in heads:
        head, file = r["value"].removeprefix("\ufeff"), unquote(r["file"])
        names = [h.strip().strip('"') for h in head.split(sep)]
        missing = [c for c in key_columns if c not in names]
        if missing:
            raise ValueError(f"{file}: header {head!r} has no column {', '.join(missing)}")
        groups[head].append(file)
    return dict(groups)


def list_files(spark: SparkSession, path: str, glob: str = "*.csv") -> list[tuple[str, int]]:
    """(address, size) of the files that are not empty; no content is read."""
    found = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
             .filter("length > 0").select("path", "length").collect())
    return sorted((r["path"], r["length"]) for r in found)


def read_delimited_dir(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ";",
                       key_columns: Sequence[str] | None = None, glob: str = "*.csv", method: str | None = None) -> DataFrame:
    """Many delimited files -> one table of ``columns`` (all STRING).

    Columns missing from a file are NULL; extra columns are ignored.
    ``method``: "scan" (one scan, ``by_name.py``) or "union" (Spark's CSV reader
    per header); by default "scan" for plain files on mounted paths.
    """
    columns = list(columns)
    keys = list(key_columns or columns[:1])
    files = list_files(spark, path, glob) if method != "union" else []
    if method is None and files:
        plain = all(f.startswith("file:") and not f.endswith(COMPRESSED) for f, _ in files)
        method = "scan" if plain else "union"
    if method == "scan" and files:
        return by_name.scan(spark, files, columns, sep, keys)
    if method != "union":
        return spark.createDataFrame([], _string_schema(columns))
    groups = file_headers(spark, path, sep, keys, glob)
    parts = []
    for header, files in sorted(groups.items()):
        names = [h.strip().strip('"') for h in header.split(sep)]
        df = (spark.read.schema(_string_schema(names)).option("sep", sep).option("header", True)
              .option("enforceSchema", True).option("mode", "PERMISSIVE").csv([_escaped(f) for f in sorted(files)]))
        present = [c for c in columns if c in names]
        parts.append(df.select(*present))
    if not parts:
        return spark.createDataFrame([], _string_schema(columns))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for c in columns:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out.select(*columns)


def read_dimension(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ";") -> DataFrame:
    """One delimited file with a header and an explicit schema; the header
    must name the schema's columns (checked, not bound by position)."""
    return (spark.read.schema(schema).option("sep", sep).option("header", True)
            .option("enforceSchema", False).csv(path))


_CHECKPOINTS: list[str] = []


def table_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/panelkit_tables/{name}"


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Typed checkpoint: Parquet, optionally partitioned (partition pruning later)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return path


def load_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def checkpoint_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write to the shared checkpoint folder and read back (cuts lineage)."""
    spark = df.sparkSession
    path = table_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    save_table(df, path, partition_by)
    _CHECKPOINTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_checkpoints(spark: SparkSession) -> int:
    """Delete the tables ``checkpoint_table`` has written in this process; call
    it once the results that read them are stored.  Returns how many."""
    n = 0
    while _CHECKPOINTS:
        n += delete_path(spark, _CHECKPOINTS.pop())
    return n


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def export_csv(df: DataFrame, path: str, sep: str = ",", single_file: bool = False) -> str:
    """CSV with a header and no row names.  ``single_file`` coalesces to one
    partition and is meant for small result tables only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def metrics_frame(spark: SparkSession, metrics: Mapping[str, object], run: str | None = None) -> DataFrame:
    """Key/value run metrics as a long ``(run, metric, value)`` table."""
    rows = [(run or "", k, None if v is None else str(v)) for k, v in metrics.items()]
    return spark.createDataFrame(rows, "run string, metric string, value string")


def write_metrics(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.mode("overwrite").json(path)
    return path


def save_model(model, path: str) -> str:
    """MLlib models through their own writer; this library's fits (dataclasses
    of numbers) as one JSON document."""
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    else:
        spark = SparkSession.getActiveSession()
        doc = spark.createDataFrame([(persist.dumps(model),)], "model string")
        doc.coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)
    return path


def save_coefficients(spark: SparkSession, path: str, terms: Sequence[str], coef, cov) -> str:
    payload = json.dumps({"terms": list(terms), "coef": [float(c) for c in coef],
                          "cov": [[float(v) for v in row] for row in cov]})
    spark.createDataFrame([(payload,)], "model string").coalesce(1).write.mode("overwrite").text(path)
    return path


def load_coefficients(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def load_model(spark: SparkSession, path: str):
    """A fit saved by ``save_model`` (not for MLlib models: use their loader)."""
    return persist.loads(spark.read.text(path).first()[0])


def fit_or_load(path: str, fit_fn, load_fn=None, exists_fn=None):
    """Reuse a saved model when there is one, else fit and save (IO5).  A model
    that is there but cannot be read raises; it is never overwritten."""
    spark = SparkSession.getActiveSession()
    if exists_fn(path) if exists_fn else path_exists(spark, path):
        return load_fn(path) if load_fn else load_model(spark, path)
    model = fit_fn()
    save_model(model, path)
    return model
