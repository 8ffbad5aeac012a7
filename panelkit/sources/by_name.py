"""Delimited files as one scan that binds columns by name (IO1).

A Spark data source of its own: the files, whatever the order of their headers,
are cut into byte ranges of bounded size, small files share a range list, and
each task binds the requested columns to the header of the file it reads. So
any number of headers is one scan, and a file's bytes are read once (later
ranges of a large file look at its head again).

A line belongs to the range that holds its first byte. Values follow RFC 4180
quoting within a line; an unquoted empty value is NULL. Rows shorter than the
header end in NULLs, longer ones lose the excess, blank lines are no rows, and
bytes that are not UTF-8 become U+FFFD. A column that a file lacks is NULL; a
file that lacks a key column stops the read with its name.

Workers open the files through Arrow's file systems: a path every executor
mounts, or an ``hdfs:``, ``s3:`` or ``gs:`` address its client can reach.
"""

from __future__ import annotations

import csv
import io
import json
import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.csv as pacsv
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "panelkit_by_name"
#: bytes of one task's ranges, and of one parsed block
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 8 << 20
#: a small file counts as this much, as opening it costs time too
OPEN_BYTES = 1 << 20


def open_file(uri: str) -> pa.NativeFile:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def first_line(f: pa.NativeFile) -> tuple[str, int]:
    """(header line, bytes it takes with its line end)."""
    head = b""
    f.seek(0)
    while b"\n" not in head:
        more = f.read(1 << 16)
        if not more:
            break
        head += more
    line, end, _ = head.partition(b"\n")
    return line.decode("utf-8", "replace").removeprefix("﻿").rstrip("\r"), len(line) + len(end)


def bind(header: str, sep: str, columns: Sequence[str], keys: Sequence[str], file: str) -> tuple[list[int | None], int]:
    """(position of each of ``columns`` or None, fields of the header)."""
    names = [h.strip() for h in next(csv.reader([header], delimiter=sep), [])]
    missing = [c for c in keys if c not in names]
    if missing:
        raise ValueError(f"{file}: header {header!r} has no column {', '.join(missing)}")
    return [names.index(c) if c in names else None for c in columns], len(names)


def ranges(files: Sequence[tuple[str, int]], split_bytes: int) -> list[list[tuple[str, int, int]]]:
    """Lists of (file, start, end) of about ``split_bytes`` each."""
    out: list[list[tuple[str, int, int]]] = []
    room = 0
    for file, size in files:
        for start in range(0, size, split_bytes):
            end = min(size, start + split_bytes)
            cost = max(end - start, min(OPEN_BYTES, split_bytes))
            if cost > room:
                out.append([])
                room = split_bytes
            out[-1].append((file, start, end))
            room -= cost
    return out


def line_blocks(f: pa.NativeFile, start: int, end: int) -> Iterator[bytes]:
    """The lines whose first byte lies in [start, end), as blocks of whole lines."""
    f.seek(start - 1 if start else 0)
    at, rest, skipping = (start - 1 if start else 0), b"", start > 0
    while True:
        block = f.read(BLOCK_BYTES)
        if not block:
            if rest and not skipping:
                yield rest
            return
        if skipping:                    # the rest of a line of the range before
            cut = block.find(b"\n")
            if cut < 0:
                at += len(block)
                continue
            at, block, skipping = at + cut + 1, block[cut + 1:], False
            if at >= end:
                return
        rest += block
        if at + len(rest) >= end:
            # the last line starts before ``end``; its end may lie beyond
            last = rest.find(b"\n", end - 1 - at)
            if last >= 0:
                yield rest[:last + 1]
                return
            continue
        last = rest.rfind(b"\n") + 1
        if last:
            yield rest[:last]
            at, rest = at + last, rest[last:]


def parse(block: bytes, sep: str, width: int, where: Sequence[int | None], columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a block of whole lines as string columns."""
    if not block.strip():
        return
    ragged: list[str] = []

    def keep(row: pacsv.InvalidRow) -> str:
        ragged.append(row.text)
        return "skip"

    names = [f"c{i}" for i in range(width)]
    used = [f"c{i}" for i in sorted({i for i in where if i is not None})]

    def read(raw: bytes) -> pa.Table:
        ragged.clear()
        return pacsv.read_csv(
            pa.BufferReader(raw), read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=max(len(raw), 1)),
            parse_options=pacsv.ParseOptions(delimiter=sep, invalid_row_handler=keep),
            convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), include_columns=used, null_values=[""],
                                                 strings_can_be_null=True, quoted_strings_can_be_null=False))

    try:
        table = read(block)
    except pa.ArrowInvalid:
        table = read(block.decode("utf-8", "replace").encode())
    schema = pa.schema([(c, pa.string()) for c in columns])
    for batch in table.to_batches():
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(batch.num_rows, pa.string()) if i is None else batch.column(used.index(f"c{i}")) for i in where], schema=schema)
    rows = [r for r, text in zip(csv.reader(io.StringIO("\n".join(ragged)), delimiter=sep), ragged) if text.strip()]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array([(r[i] or None) if i is not None and i < len(r) else None for r in rows], pa.string()) for i in where], schema=schema)


class Ranges(InputPartition):
    def __init__(self, parts: list[tuple[str, int, int]]):
        super().__init__(None)
        self.parts = parts


class ByNameReader(DataSourceReader):
    def __init__(self, columns: list[str], options: dict):
        self.columns = columns
        self.sep, self.keys = options["sep"], json.loads(options["keys"])
        self.files = [tuple(x) for x in json.loads(options["files"])]
        self.split_bytes = int(options["split_bytes"])

    def partitions(self) -> list[InputPartition]:
        return [Ranges(p) for p in ranges(self.files, self.split_bytes)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for file, start, end in partition.parts:
            with open_file(file) as f:
                header, skip = first_line(f)
                where, width = bind(header, self.sep, self.columns, self.keys, file)
                if max(start, skip) < end:
                    for block in line_blocks(f, max(start, skip), end):
                        yield from parse(block, self.sep, width, where, self.columns)


class ByNameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema: T.StructType) -> ByNameReader:
        # the files are the driver's list: the reader is planned without a session
        return ByNameReader(schema.fieldNames(), dict(self.options))


def check_headers(spark: SparkSession, files: Sequence[tuple[str, int]], sep: str, keys: Sequence[str]) -> None:
    """Stops with the name of a file that lacks a key column; heads are read by tasks."""
    keys = list(keys)

    def bad(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with open_file(file) as f:
                    try:
                        bind(first_line(f)[0], sep, keys, keys, file)
                    except ValueError as e:
                        yield pa.RecordBatch.from_arrays([pa.array([str(e)])], names=["message"])
                        return

    tasks = max(1, min(len(files) // 16, spark.sparkContext.defaultParallelism * 4))
    listed = spark.createDataFrame([(f,) for f, _ in files], "file string").repartition(tasks)
    found = listed.mapInArrow(bad, "message string").first()
    if found:
        raise ValueError(found["message"])


def scan(spark: SparkSession, files: Sequence[tuple[str, int]], columns: Sequence[str], sep: str, keys: Sequence[str],
         split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One scan over ``files`` (address, size) of ``columns``, all STRING."""
    # executors need not have this package installed
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    check_headers(spark, files, sep, keys)
    spark.dataSource.register(ByNameSource)
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    return (spark.read.format(NAME).schema(schema).option("sep", sep).option("keys", json.dumps(list(keys)))
            .option("files", json.dumps([list(x) for x in files])).option("split_bytes", str(split_bytes)).load())
