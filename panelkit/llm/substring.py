"""Substring dedup over word windows with a count-min prefilter.

Every word covered by a window of ``window`` consecutive words whose sequence
also starts elsewhere is removed; windows are judged on the input.

First pass: each partition keeps a count-min sketch of the anchor grams its
windows select (``anchors.py``): two hash rows of cells that count to two. A
window's places are at most its anchor's, and a cell counts every anchor that
falls into it, so a merged cell below two proves that a window is unique. The
sketches are sparse, cut into shards of cells and merged shard by shard.

Second pass: only windows whose anchor is estimated repeated in both rows are
grouped, exactly, by 128-bit hashes of their words (``repeats.py``). The sketch
errs on one side only, so no repeat is lost; its size follows the input, and
where it would be too large to hand to every task, the anchors are joined to
its cells instead.

Words are runs of anything but space and the characters 9 to 13, unchanged.
Defined results: null, empty and blank texts have no words and the hash of the
empty string; texts shorter than a window keep every word; repeated rows repeat
each other, so both lose their windows; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import repeats
from panelkit.llm.anchors import BASES, Spans, Symbols, find_runs, word_symbols
from panelkit.llm.common import BROADCAST_LIMIT_BYTES, written

WINDOW = 35
GRAM = 12
#: grams with more different contexts are resolved window by window
MAX_CONTEXTS = 4096

ROWS = 2
SHARD_BITS = 18
#: multipliers that pick a gram's cell in each row
ROW_HASH = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def cell_bits(total_bytes: int) -> int:
    """About four cells per expected anchor (one anchor per 64 bytes of text)."""
    return max(SHARD_BITS, math.ceil(math.log2(max(total_bytes, 1) / 16 + 1)))


def cells(gram: np.ndarray, bits: int, row: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (gram * np.uint64(ROW_HASH[row])) >> np.uint64(64 - bits)


def sketch(rows: DataFrame, window: int, gram: int, bits: int) -> DataFrame:
    """(shard, hot): per shard of cells a bitmap of those that count two or more."""
    flush = 2_000_000

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit() -> Iterator[pa.RecordBatch]:
            grams = np.concatenate(held)
            for row in range(ROWS):
                cell, count = np.unique(cells(grams, bits, row), return_counts=True)
                shard = (cell >> np.uint64(SHARD_BITS)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                low = (cell & np.uint64((1 << SHARD_BITS) - 1)).astype(np.uint32)
                # bit 31 marks a cell that this sketch alone has counted twice
                word = (low | ((count > 1).astype(np.uint32) << np.uint32(31)))
                pieces = [p.tobytes() for p in np.split(word, cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut] * ROWS + row), pa.array(pieces, pa.binary())], names=["shard", "cells"])

        for batch in batches:
            for _, raws in repeats.slices(batch, 2):
                held.append(find_runs(word_symbols(raws), window, gram).gram)
                if sum(map(len, held)) > flush:
                    yield from emit()
                    held = []
        if held and sum(map(len, held)):
            yield from emit()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << SHARD_BITS, dtype=np.uint8)
        for piece in pdf["cells"]:
            word = np.frombuffer(piece, dtype=np.uint32)
            low = word & np.uint32(0x7FFFFFFF)                 # distinct within a piece
            counts[low] = np.minimum(counts[low] + 1 + (word >> np.uint32(31)).astype(np.uint8), 2)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "hot": [np.packbits(counts > 1).tobytes()]})

    return rows.mapInArrow(partial, "shard long, cells binary").groupBy("shard").applyInPandas(merge, "shard long, hot binary")


def _hot_runs(rows: DataFrame, hot: DataFrame, window: int, gram: int, bits: int) -> DataFrame:
    """Runs whose anchor is hot in both rows of the sketch."""
    size = ROWS << bits >> 3
    if size <= BROADCAST_LIMIT_BYTES:
        maps = np.zeros((ROWS, 1 << bits >> 3), dtype=np.uint8)
        step = 1 << SHARD_BITS >> 3
        for r in hot.toLocalIterator():
            at = r.shard // ROWS * step
            maps[r.shard % ROWS, at:at + step] = np.frombuffer(r.hot, dtype=np.uint8)
        shared = rows.sparkSession.sparkContext.broadcast(maps)      # its size has just been checked

        def wanted(g: np.ndarray) -> np.ndarray:
            ok = np.ones(len(g), dtype=bool)
            for row in range(ROWS):
                cell = cells(g, bits, row)
                bit = shared.value[row, (cell >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))
                ok &= (bit & 1).astype(bool)
            return ok

        return repeats.run_rows(rows, word_symbols, window, gram, wanted)

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, bitmap in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(low), shard % ROWS, dtype=np.int32)), pa.array(low + (shard // ROWS << SHARD_BITS))], names=["row", "cell"])

    listed = written(hot.mapInArrow(exploded, "row int, cell long"), "hot_cells")
    runs = written(repeats.run_rows(rows, word_symbols, window, gram), "runs")
    for row, by in enumerate(ROW_HASH):
        runs = runs.withColumn("cell", _cell_column("g", by, bits)).join(listed.filter(F.col("row") == row).select("cell"), "cell", "left_semi").drop("cell")
    return runs


def _cell_column(g: str, by: int, bits: int):
    @F.pandas_udf("long")
    def cell(x: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(((x.to_numpy(np.int64).view(np.uint64) * np.uint64(by)) >> np.uint64(64 - bits)).astype(np.int64))
    return cell(F.col(g))


def _window_hashes(s: Symbols, window: int, first: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Per context the 128-bit hashes of its windows."""
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    both = np.empty((len(at), 2), dtype=np.uint64)
    for k, base in enumerate(BASES):
        both[:, k] = Spans(s.x, base)(at, at + window)
    ends = np.cumsum(n) * 16
    blob = both.tobytes()
    return [blob[e - m * 16:e] for e, m in zip(ends.tolist(), n.tolist())]


def _equal_windows(g: np.ndarray, n: np.ndarray, bodies: list[bytes]) -> list[np.ndarray]:
    """Per context flags of the windows another context holds too (a context may repeat itself)."""
    both = np.frombuffer(b"".join(bodies), dtype=np.uint64).reshape(-1, 2)
    order = np.lexsort((both[:, 1], both[:, 0]))
    same = (both[order[1:]] == both[order[:-1]]).all(axis=1)
    flag = np.zeros(len(both), dtype=bool)
    flag[order[1:]] |= same
    flag[order[:-1]] |= same
    return np.split(flag, np.cumsum(n)[:-1])


def remove_spans(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept text of rows with their spans ``gone``."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raws in repeats.slices(batch, 1):
                out = []
                for raw, gone in zip(raws, part.column(2).to_pylist()):
                    words = raw.split()
                    kept, at = words, 0
                    if gone:
                        kept = []
                        for span in gone:
                            kept += words[at:span["start"]]
                            at = span["end"]
                        kept += words[at:]
                    text = b" ".join(kept)
                    out.append((len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(), text))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                     pa.array(cols[3], pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.select("doc_id", "body", "gone").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
                    max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space) per row."""
    gram = min(gram, window)
    rows = repeats.plain_rows(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    bits = cell_bits(total)
    hot = written(sketch(rows, window, gram, bits), "sketch")
    runs = written(_hot_runs(rows, hot, window, gram, bits), "runs")

    def hashes(s, raws, row, first, n):
        return _window_hashes(s, window, first, n)

    spans = repeats.removal_spans(rows, runs, word_symbols, window, max_contexts, hashes, _equal_windows)
    return remove_spans(repeats.with_spans(rows, spans))
