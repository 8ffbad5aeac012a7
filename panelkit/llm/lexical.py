"""Ranked lexical search with LEMP-style norm buckets.

Terms are runs of ASCII letters and digits and of anything beyond ASCII, only
A-Z lower-cased. A document's impact vector holds, for each query term t in it,
w(t) * floor(10^9 tf / (1000 tf + 8 m)), an integer; an item's vector holds the
repeats of its terms. A score is their dot product.

Method (items in blocks, each against every document):
1. One pass over the whole texts counts terms and keeps each document's counts
   of the query terms; N, L and the document frequencies are aggregates of it.
2. Impact vectors are ordered by length (Euclidean norm) and cut into buckets:
   a range partitioning by falling norm, ties spread by row, whose Arrow batches
   are the buckets. The bucket of the longest vectors is scored first; its
   k-th best scores are the starting thresholds.
3. Within a bucket an item is dropped when |item| * (longest norm) stays below its
   threshold (Cauchy-Schwarz), or when the bucket's largest coordinates do. Of the rest,
   the item's coordinates that even together cannot reach the threshold are set
   aside; only documents holding another one are looked at, and those whose
   partial sum plus the bound of the rest stays below are dropped.
4. Survivors are scored exactly in 64-bit integers. Bounds are compared with a
   slack that covers rounding, so no document of the top k is lost. A task keeps the best k
   per item and raises its thresholds as it goes on.

Defined results: null and empty texts hold no terms and count neither in N nor
in L; items without terms have no rows. Repeated rows are documents of their own;
equal scores rank by ascending doc_id, null ids last, then by row. Rows of equal
item_id are items of their own. An empty table gives an empty result. Extra
columns are ignored. Per task the memory is one bucket of vectors and k rows per
item of a block.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import task_count, written

TOP_K = 10
#: items searched for at a time; their terms and thresholds go to every task
ITEMS_PER_BLOCK = 2000
#: about as many documents are scored for the starting thresholds
SEED_ROWS = 20_000
#: documents of a bucket
BUCKET_ROWS = 2000
#: relative slack of bounds computed in doubles
SLACK = 1e-9

#: fixed values of the scoring formula
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, LENGTH_SCALE, LENGTH_SHARE = 1000, 1_000_000_000, 1000, 8, 75


def _fold_table() -> bytes:
    """Byte map: separators become spaces, A-Z lower case, the rest stays."""
    def image(b: int) -> int:
        if 0x41 <= b <= 0x5A:
            return b + 32
        return b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    return bytes(map(image, range(256)))


FOLD = _fold_table()


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, n, terms, tfs): n terms of the whole text and its counts of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)      # the terms of one block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = known.value.get
        for batch in batches:
            n, sizes, ids, tfs = [], [0], [], []
            for text in batch.column(1):
                words = terms_of(text.as_py())
                held = Counter(map(look, words))
                held.pop(None, None)
                n.append(len(words))
                ids.extend(held.keys())
                tfs.extend(held.values())
                sizes.append(len(ids))
            at = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(tfs, pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")).mapInArrow(
        run, f"doc_id {kind}, n long, terms array<int>, tfs array<long>")
    return written(counted.withColumn("row", F.monotonically_increasing_id()), "terms")


def impact_vectors(counted: DataFrame, n_docs: int, total: int, weights: np.ndarray) -> DataFrame:
    """(row, doc_id, norm, terms, impacts) of the documents that hold a query term."""
    table = counted.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = table.value
        for batch in batches:
            sizes = np.diff(batch.column("terms").offsets.to_numpy())
            terms, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
            m = 100 - LENGTH_SHARE + (LENGTH_SHARE * batch.column("n").to_numpy() * n_docs) // total
            doc = np.repeat(np.arange(len(sizes)), sizes)
            impact = w[terms] * ((IMPACT_SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * m[doc]))
            norm = np.sqrt(np.bincount(doc, weights=impact.astype(np.float64) ** 2, minlength=len(sizes)))
            lists = pa.ListArray.from_arrays(batch.column("terms").offsets, pa.array(impact))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(norm), batch.column("terms"), lists],
                                             names=["row", "doc_id", "norm", "terms", "impacts"])

    kind = counted.schema["doc_id"].dataType.simpleString()
    return counted.filter("size(terms) > 0").select("row", "doc_id", "n", "terms", "tfs").mapInArrow(
        run, f"row long, doc_id {kind}, norm double, terms array<int>, impacts array<long>")


class Items:
    """The vectors of a block of items in rows of ids and repeats."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]]):
        self.vectors = vectors
        self.norms = np.array([math.sqrt(float((r * r).sum())) for _, r in vectors])
        self.ids = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, dtype=np.int64)
        self.repeats = np.concatenate([r for _, r in vectors]) if vectors else np.zeros(0, dtype=np.int64)
        self.item = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])


class Bucket:
    """Impact vectors of similar length, by document and as postings by term."""

    def __init__(self, norm: np.ndarray, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.norm, self.n = norm, len(norm)
        self.longest = float(norm.max())
        doc = np.repeat(np.arange(self.n), np.diff(offsets))
        order = np.argsort(terms, kind="stable")
        self.doc, self.impact = doc[order], impacts[order]
        self.stops = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.highest = np.zeros(n_terms, dtype=np.int64)
        np.maximum.at(self.highest, terms, impacts)

    def survivors(self, terms: np.ndarray, repeats: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) of all documents scoring at least ``threshold``, for one item."""
        reach = repeats * self.highest[terms]
        order = np.argsort(reach, kind="stable")
        terms, repeats, reach = terms[order], repeats[order], reach[order]
        # coordinates that cannot reach the threshold together: by their largest values or by length
        by_height = np.cumsum(reach).astype(np.float64)
        by_length = np.sqrt(np.cumsum((repeats * repeats).astype(np.float64))) * self.longest
        aside = int(np.searchsorted(np.minimum(by_height, by_length), threshold * (1 - SLACK)))
        focus = range(aside, len(terms))
        score, length = np.zeros(self.n, dtype=np.int64), np.zeros(self.n)
        for k in focus:
            s, e = self.stops[terms[k]], self.stops[terms[k] + 1]
            score[self.doc[s:e]] += repeats[k] * self.impact[s:e]
            length[self.doc[s:e]] += self.impact[s:e].astype(np.float64) ** 2
        left = np.flatnonzero(score)
        if aside:
            rest = np.sqrt(np.maximum(self.norm[left] ** 2 - length[left], 0) + SLACK * self.norm[left] ** 2)
            bound = np.minimum(by_height[aside - 1], math.sqrt(float((repeats[:aside] ** 2).sum())) * rest)
            left = left[score[left] + bound >= threshold * (1 - SLACK)]
            if len(left):
                wanted = np.zeros(self.n, dtype=bool)
                wanted[left] = True
                for k in range(aside):
                    s, e = self.stops[terms[k]], self.stops[terms[k] + 1]
                    here = wanted[self.doc[s:e]]
                    score[self.doc[s:e][here]] += repeats[k] * self.impact[s:e][here]
        left = left[score[left] >= threshold]
        return left, score[left]


class Best:
    """The best k (score, doc_id, row) of each item."""

    def __init__(self, thresholds: np.ndarray, k: int):
        self.thresholds, self.k = thresholds.copy(), k
        self.heaps: dict[int, list[tuple]] = {}

    def add(self, item: int, scores: list[int], ids: list, rows: list[int]) -> None:
        heap = self.heaps.setdefault(item, [])
        for s, i, r in zip(scores, ids, rows):
            entry = (s, _Last((i is None, i, r)))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif heap[0] < entry:
                heapq.heapreplace(heap, entry)
        if len(heap) == self.k:
            self.thresholds[item] = max(int(self.thresholds[item]), heap[0][0])


class _Last(tuple):
    """Ids in falling order, so that the heap's root is the one to go first."""

    def __lt__(self, other):
        if self[0] != other[0]:
            return self[0] > other[0]
        return tuple(other[1:]) < tuple(self[1:]) if not self[0] else other[2] < self[2]


def search_buckets(vectors: DataFrame, items: Items, thresholds: np.ndarray, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, row, score): per task and item the best ``k`` documents that reach the threshold."""
    shared = vectors.sparkSession.sparkContext.broadcast((items, thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = shared.value
        best = Best(start, k)
        for batch in batches:
            for at in range(0, batch.num_rows, BUCKET_ROWS):
                part = batch.slice(at, BUCKET_ROWS)
                held = part.column("terms")
                bucket = Bucket(part.column("norm").to_numpy(), held.offsets.to_numpy() - held.offsets[0].as_py(), held.flatten().to_numpy(),
                                part.column("impacts").flatten().to_numpy(), n_terms)
                limit = best.thresholds * (1 - SLACK)
                height = np.bincount(known.item, weights=(known.repeats * bucket.highest[known.ids]).astype(np.float64), minlength=len(limit))
                ids, rows = part.column("doc_id"), part.column("row").to_numpy()
                for item in np.flatnonzero((known.norms * bucket.longest >= limit) & (height >= limit)):
                    docs, scores = bucket.survivors(*known.vectors[item], int(best.thresholds[item]))
                    if len(docs):
                        best.add(int(item), scores.tolist(), ids.take(pa.array(docs)).to_pylist(), rows[docs].tolist())
        found = [(item, e[1][1], e[1][2], e[0]) for item, heap in best.heaps.items() for e in heap]
        if found:
            columns = list(zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], kind_of), pa.array(columns[2], pa.int64()),
                                              pa.array(columns[3], pa.int64())], names=["item", "doc_id", "row", "score"])

    from pyspark.sql.pandas.types import to_arrow_type
    kind_of = to_arrow_type(vectors.schema["doc_id"].dataType)
    kind = vectors.schema["doc_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"item int, doc_id {kind}, row long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each item; Spark cuts each task's share to k rows before the shuffle."""
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _by_length() -> list[Column]:
    """Falling length; documents of one length (copies) are spread by their row."""
    return [F.col("norm").desc(), F.xxhash64("row").asc()]


def _longest(by_length: DataFrame) -> DataFrame:
    """About ``SEED_ROWS`` of the longest vectors. Any documents give valid starting
    thresholds, so copies of one length may be thinned out by a hash of the row."""
    step = F.floor(F.log(F.greatest("norm", F.lit(1.0))) * 64)
    held, cut = 0, None
    for cut, rows in by_length.groupBy(step.alias("step")).count().orderBy(F.col("step").desc()).toLocalIterator():      # some hundred rows
        held += rows
        if held >= SEED_ROWS:
            break
    if cut is None:
        return by_length
    return by_length.filter((step >= cut) & (F.pmod(F.xxhash64("row", F.lit(1)), F.lit(1 << 30)) < F.lit(math.ceil(SEED_ROWS / held * (1 << 30)))))


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", k: int = TOP_K, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item."""
    numbered = written(items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("body"))
                       .withColumn("nr", F.monotonically_increasing_id()), "items")
    blocks, block = [], []
    for row in numbered.toLocalIterator():          # one block of the query set at a time
        block.append((row.item_id, terms_of(row.body)))
        if len(block) == items_per_block:
            blocks.append(_search_block(docs, block, numbered.schema["item_id"].dataType.simpleString(), id_col, text_col, k))
            block = []
    if block or not blocks:
        blocks.append(_search_block(docs, block, numbered.schema["item_id"].dataType.simpleString(), id_col, text_col, k))
    out = blocks[0]
    for other in blocks[1:]:
        out = out.unionByName(other)
    return out


def _search_block(docs: DataFrame, block: list[tuple[object, list[bytes]]], item_kind: str, id_col: str, text_col: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    counted = term_counts(docs, vocabulary, id_col, text_col)
    n_docs, total = counted.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator())      # at most the block's terms
    weights = np.array([weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))], dtype=np.int64)
    vectors = []
    for _, terms in block:
        held = Counter(vocabulary[t] for t in terms)
        vectors.append((np.array(sorted(held), dtype=np.int64), np.array([held[t] for t in sorted(held)], dtype=np.int64)))
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], f"item int, item_id {item_kind}")
    known = Items(vectors)
    by_length = impact_vectors(counted, n_docs, max(total, 1), weights)
    by_length = written(by_length.repartitionByRange(task_count(spark), *_by_length()).sortWithinPartitions(*_by_length()), "impacts")
    start = np.ones(len(block), dtype=np.int64)
    seeds = _ranked(search_buckets(_longest(by_length), known, start, len(vocabulary), k), k).filter(F.col("rank") == k)
    for item, score in seeds.select("item", "score").toLocalIterator():                                  # one row per item
        start[item] = max(1, score)
    found = _ranked(search_buckets(by_length, known, start, len(vocabulary), k), k)
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SQL = f"""
    WITH cut AS (SELECT row_number() OVER () AS row_no, doc_id, {_TERMS} AS terms FROM documents),
    held AS (SELECT row_no, doc_id, terms, len(terms) AS n FROM cut WHERE len(terms) > 0),
    totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM held),
    counts AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM held) GROUP BY row_no, term),
    asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
    weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
                FROM counts, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, docs),
    scores AS (SELECT item_id, row_no, doc_id,
                      CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // len)))) AS BIGINT) AS score
               FROM asked JOIN weights USING (term) JOIN counts USING (term) JOIN held USING (row_no), totals
               GROUP BY item_id, row_no, doc_id),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row_no) AS INTEGER) AS rank, doc_id, score
               FROM scores WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP_K}
"""
