"""Substring dedup over bytes by interval expansion on Burrows-Wheeler transforms.

Every byte covered by a string of ``least`` bytes that also starts elsewhere is
removed; strings are judged on the input and never cross documents.

One transform of the whole corpus would not be distributed. Equal strings of
``least`` bytes select the same anchor gram (``anchors.py``), so the corpus is
cut into the contexts of its anchors: those that stand twice as a whole are
settled by grouping, and the different contexts of one gram are brought
together, a few megabytes of whole grams at a time. Each such piece gets its own
transform, on which threshold-bounded interval expansion (``bwt.py``) finds the
strings of ``least`` bytes that start at two places (``repeats.py``).

Defined results: null and empty texts have no bytes, no spans and the hash of
the empty string; texts shorter than ``least`` are kept whole; repeated rows
repeat each other; an empty table gives an empty result; extra columns are
ignored. What is left of a text may end inside a character, so it is binary.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.llm import repeats
from panelkit.llm.anchors import byte_symbols
from panelkit.llm.bwt import repeated_starts
from panelkit.llm.common import maybe_broadcast, written

LEAST = 400
GRAM = 48
MAX_CONTEXTS = 2048


def remove_spans(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of rows with their spans ``gone``."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raws in repeats.slices(batch, 1):
                out = []
                for raw, gone in zip(raws, part.column(2).to_pylist()):
                    kept, at = [], 0
                    for span in gone or ():
                        kept.append(raw[at:span["start"]])
                        at = span["end"]
                    kept = b"".join([*kept, raw[at:]])
                    out.append((len(raw), len(raw) - len(kept), len(gone or ()), hashlib.sha256(kept).hexdigest(), kept))
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.select("doc_id", "body", "gone").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM,
                 max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left) per row."""
    gram = min(gram, least)
    rows = repeats.plain_rows(docs, id_col, text_col)
    every = written(repeats.run_rows(rows, byte_symbols, least, gram), "runs")
    twice = written(every.groupBy("g").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("g"), "repeated_grams")
    runs = written(every.join(maybe_broadcast(twice, 16), "g", "left_semi"), "repeated_runs")

    def contexts(s, raws, row, first, n):
        start = first - s.bounds[row]
        return [raws[r][a:a + m + least - 1] for r, a, m in zip(row.tolist(), start.tolist(), n.tolist())]

    def resolve(g: np.ndarray, n: np.ndarray, bodies: list[bytes]) -> list[np.ndarray]:
        return repeated_starts(bodies, least)

    spans = repeats.removal_spans(rows, runs, byte_symbols, least, max_contexts, contexts, resolve)
    return remove_spans(repeats.with_spans(rows, spans))
