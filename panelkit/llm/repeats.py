"""Spans of repeated windows, found through anchor runs.

A run (``anchors.py``) is several consecutive windows of one row that share an
anchor gram; its context is the text those windows cover. Windows can only equal
windows of the same gram, so

1. runs are grouped by their whole context (128-bit hash, partial aggregation):
   where a context stands twice, all its windows repeat;
2. a context that stands once is compared with the other contexts of its gram
   only; a method-specific resolver tells which of its windows stand there too;
3. grams with more than ``max_contexts`` different contexts are not brought
   together: the windows of their contexts are counted one by one in a partial
   aggregation keyed by the window.

Rows are known by their id and a hash of their text, so equal ids with
different texts stay apart and repeated rows count as different places.
Removal spans are merged per row and joined back to the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.anchors import BASES, Runs, Spans, Symbols, find_runs
from panelkit.llm.common import text_or_empty, written

SALTS = 16
#: text of one slice; its symbols and hashes take about a hundred times as much
SLICE_BYTES = 1_500_000
#: contexts compared at a time
COMPARE_BYTES = 2_000_000

SymbolsOf = Callable[[list[bytes]], Symbols]


def plain_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, th, body; the text as bytes, null as empty."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("body"))


def slices(batch: pa.RecordBatch, body: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in pieces of bounded text."""
    sizes = np.asarray(pc.binary_length(batch.column(body)))
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > SLICE_BYTES:
            part = batch.slice(start, i - start)
            yield part, [x or b"" for x in part.column(body).to_pylist()]
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        part = batch.slice(start)
        yield part, [x or b"" for x in part.column(body).to_pylist()]


def run_rows(rows: DataFrame, symbols_of: SymbolsOf, length: int, gram: int,
             wanted: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """g, c1, c2, doc_id, th, start, n of the runs whose gram is ``wanted``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raws in slices(batch, 2):
                s = symbols_of(raws)
                r = find_runs(s, length, gram)
                if wanted is not None:
                    keep = np.flatnonzero(wanted(r.gram))
                    r = Runs(r.row[keep], r.start[keep], r.count[keep], r.gram[keep])
                if not len(r.row):
                    continue
                end = r.start + r.count + length - 1
                c1, c2 = (Spans(s.x, b)(r.start, end) for b in BASES)
                at = pa.array(r.row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.gram.view(np.int64)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
                     part.column(0).take(at), part.column(1).take(at), pa.array((r.start - s.bounds[r.row]).astype(np.int32)),
                     pa.array(r.count.astype(np.int32))], names=["g", "c1", "c2", "doc_id", "th", "start", "n"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"g long, c1 long, c2 long, doc_id {kind}, th long, start int, n int")


def _salted_semi(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with a match in ``keys`` (distinct); a hot key's rows are spread over salts."""
    wide = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("th", "start"), F.lit(SALTS)).cast("int")) \
        .join(wide, [*on, "salt"], "left_semi").drop("salt")


def removal_spans(rows: DataFrame, runs: DataFrame, symbols_of: SymbolsOf, length: int, max_contexts: int,
                  payload: Callable[[Symbols, list[bytes], np.ndarray, np.ndarray, np.ndarray], list[bytes]],
                  resolve: Callable[[np.ndarray, np.ndarray, list[bytes]], list[np.ndarray]]) -> DataFrame:
    """doc_id, th, start, end of the merged removal spans, in symbols of the row.

    ``payload`` gives what the resolver needs of each context; ``resolve`` takes
    the payloads of the contexts of one or more grams and returns, per context,
    flags of its windows that another context holds too.
    """
    contexts = written(runs.groupBy("g", "c1", "c2").agg(
        F.count(F.lit(1)).alias("places"), F.min(F.struct("doc_id", "th", "start", "n")).alias("at")), "contexts")
    twice = contexts.filter("places > 1").select("c1", "c2")
    whole = _salted_semi(runs, twice, ["c1", "c2"]).select("doc_id", "th", "start", (F.col("start") + F.col("n") + length - 1).alias("end"))
    grams = contexts.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("places") == 1).alias("lone"))
    grams = written(grams.filter("m > 1 and lone > 0").select("g", (F.col("m") > max_contexts).alias("hot")), "grams")
    wide = grams.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    need = (contexts.withColumn("salt", F.pmod(F.col("c1"), F.lit(SALTS)).cast("int")).join(wide, ["g", "salt"])
            .select("at.doc_id", "at.th", F.struct(F.col("at.start").alias("start"), F.col("at.n").alias("n"), "g",
                                                   (F.col("places") == 1).alias("lone"), "hot").alias("c")))
    need = written(need, "needed")
    per_row = need.groupBy("doc_id", "th").agg(F.collect_list("c").alias("contexts"))
    asked = _with_texts(rows, per_row, need)
    cold = _resolve_cold(asked, symbols_of, length, payload, resolve)
    spans = whole.unionByName(cold)
    if not grams.filter("hot").isEmpty():
        spans = spans.unionByName(_resolve_hot(asked, symbols_of, length))
    return merge_spans(spans)


def _with_texts(rows: DataFrame, per_row: DataFrame, need: DataFrame) -> DataFrame:
    """Texts of the rows that hold a context to compare; one of equal rows is enough."""
    n = need.count()
    side = per_row if n * 40 > 32 << 20 else F.broadcast(per_row)
    # rows repeated with equal id and text would offer their contexts twice
    return rows.join(side, rows["doc_id"].eqNullSafe(side["doc_id"]) & (rows["th"] == side["th"])) \
        .select(rows["doc_id"], rows["th"], rows["body"], "contexts")


def _asked(part: pa.RecordBatch, hot: bool) -> tuple[np.ndarray, ...]:
    """Flat arrays of the contexts of a slice: row, start, n, g, lone."""
    lists = part.column(3)
    flat = lists.flatten()
    row = np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(lists)))
    start, n, g, lone, is_hot = (np.asarray(flat.field(k)) for k in ("start", "n", "g", "lone", "hot"))
    keep = is_hot == hot
    return row[keep], start[keep].astype(np.int64), n[keep].astype(np.int64), g[keep], lone[keep]


def _resolve_cold(asked: DataFrame, symbols_of: SymbolsOf, length: int, payload: Callable, resolve: Callable) -> DataFrame:
    kind = asked.schema["doc_id"].dataType.simpleString()

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raws in slices(batch, 2):
                row, start, n, g, lone = _asked(part, False)
                if not len(row):
                    continue
                s = symbols_of(raws)
                first = s.bounds[row] + start
                for at in range(0, len(row), 20_000):
                    cut = slice(at, at + 20_000)
                    bodies = payload(s, raws, row[cut], first[cut], n[cut])
                    take = pa.array(row[cut])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[cut]), part.column(0).take(take), part.column(1).take(take), pa.array(start[cut].astype(np.int32)),
                         pa.array(n[cut].astype(np.int32)), pa.array(lone[cut]), pa.array(bodies, pa.binary())],
                        names=["g", "doc_id", "th", "start", "n", "lone", "body"])

    def settle(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        n = table["n"].to_numpy()
        flags = resolve(table["g"].to_numpy(), n, table["body"].to_pylist())
        lone, start = table["lone"].to_numpy(zero_copy_only=False), table["start"].to_numpy()
        at, lo, hi = [], [], []
        for i in np.flatnonzero(lone):
            f = flags[i]
            if f.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[0], f.view(np.int8), [0]])))
                lo.append(start[i] + edge[0::2])
                hi.append(start[i] + edge[1::2] + length - 1)
                at.append(np.full(len(lo[-1]), i))
        if at:
            take = pa.array(np.concatenate(at))
            ids, ths = table["doc_id"].combine_chunks().take(take), table["th"].combine_chunks().take(take)
            yield pa.RecordBatch.from_arrays([ids, ths, pa.array(np.concatenate(lo).astype(np.int32)), pa.array(np.concatenate(hi).astype(np.int32))],
                                             names=["doc_id", "th", "start", "end"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by gram; whole grams are settled together, some megabytes at a time."""
        held: list[pa.RecordBatch] = []
        held_bytes = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            start = 0
            while start < batch.num_rows:
                rest = batch.slice(start)
                g = rest.column(0).to_numpy()
                sizes = np.cumsum(np.asarray(pc.binary_length(rest.column(6))))
                room = int(np.searchsorted(sizes, COMPARE_BYTES - held_bytes))
                if room >= rest.num_rows:
                    held.append(rest)
                    held_bytes += int(sizes[-1])
                    break
                # close at the next border between grams
                border = np.flatnonzero(g[1:] != g[:-1]) + 1
                later = border[border >= max(room, 1)]
                if held and g[0] != held[-1].column(0)[-1].as_py() and room == 0:
                    cut = 0
                elif len(later):
                    cut = int(later[0])
                else:
                    held.append(rest)
                    held_bytes += int(sizes[-1])
                    break
                if cut:
                    held.append(rest.slice(0, cut))
                yield from settle(held)
                held, held_bytes = [], 0
                start += cut
        if held:
            yield from settle(held)

    offered = asked.mapInArrow(offer, f"g long, doc_id {kind}, th long, start int, n int, lone boolean, body binary")
    return (offered.repartition("g").sortWithinPartitions("g")
            .mapInArrow(compare, f"doc_id {kind}, th long, start int, end int"))


def _resolve_hot(asked: DataFrame, symbols_of: SymbolsOf, length: int) -> DataFrame:
    """Windows of hot grams one by one, counted by their 128-bit hashes."""
    kind = asked.schema["doc_id"].dataType.simpleString()

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raws in slices(batch, 2):
                row, start, n, _, lone = _asked(part, True)
                if not len(row):
                    continue
                s = symbols_of(raws)
                hashes = [Spans(s.x, b) for b in BASES]
                for at in range(0, len(row), 2_000):
                    cut = slice(at, at + 2_000)
                    k = np.repeat(np.arange(len(row[cut])), n[cut])
                    step = np.arange(len(k)) - np.repeat(np.cumsum(n[cut]) - n[cut], n[cut])
                    first = (s.bounds[row[cut]] + start[cut])[k] + step
                    take = pa.array(row[cut][k])
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(h(first, first + length).view(np.int64)) for h in hashes), part.column(0).take(take), part.column(1).take(take),
                         pa.array((start[cut][k] + step).astype(np.int32)), pa.array(lone[cut][k])],
                        names=["w1", "w2", "doc_id", "th", "start", "lone"])

    windows = asked.mapInArrow(offer, f"w1 long, w2 long, doc_id {kind}, th long, start int, lone boolean")
    known = windows.groupBy("w1", "w2").agg(F.sum(F.when(F.col("lone"), 1).otherwise(2)).alias("weight"))
    known = written(known.filter("weight > 1").select("w1", "w2"), "hot_windows")
    return _salted_semi(windows.filter("lone"), known, ["w1", "w2"]).select(
        "doc_id", "th", "start", (F.col("start") + length).alias("end"))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a row become one."""
    # per row and block of starts first: copies and overlaps shrink before the window
    inside = Window.partitionBy("doc_id", "th").orderBy("start", "end")
    before = F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.distinct().withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    numbered = fresh.withColumn("k", F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "th", "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` with the sorted array ``gone`` of its (start, end) spans, null where it has none."""
    spans = written(spans, "spans")
    n = spans.count()
    lists = spans.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    side = F.broadcast(lists) if n * 48 <= 24 << 20 else lists
    return rows.join(side, rows["doc_id"].eqNullSafe(side["doc_id"]) & (rows["th"] == side["th"]), "left") \
        .select(rows["doc_id"], rows["th"], rows["body"], "gone")
