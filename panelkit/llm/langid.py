"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to ``ORDER``: how often each
byte followed each context in its training texts, contexts at a text's start
holding start marks. The statistics are frozen after training. A byte's code
length in a context is -log2 n/(N+d) where the byte was seen there n times, out
of N occurrences of d distinct bytes; an unseen byte pays the escape
-log2 d/(N+d) and is coded in the next shorter context without the bytes of the
longer one (exclusion), at last uniformly over the bytes left. Contexts that were
never seen are passed over. A text gets the language whose tree gives the
shortest code; the score is that language's share of 2^-length over all of them.

Texts are folded first: lower case, and every run of other characters than
letters and marks becomes one space. Code lengths are rounded to 2^-20 bit, so
sums are exact in any order and a text scores the same in any batch.

Training takes at most about ``per_language`` documents per language, chosen by
a hash of id and text (a documented bound on the training sample only); grams are
counted by Spark over whole texts. All languages together keep at most
``MAX_GRAMS`` grams, by a count threshold per language common to all orders,
which bounds the tables that every task gets. Scoring covers every whole text, in one pass
without a shuffle; only a slice of bytes is held as numbers at a time.

Defined results: null texts and texts without a letter are ``und`` with score 0,
as is every text where nothing could be learned; null ids count as held out;
rows with null language teach nothing; equal lengths go to the first language in
code point order. Repeated rows repeat; empty tables give empty results; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import maybe_broadcast, written

#: bytes of the longest context
ORDER = 4
#: a byte is coded as itself plus one; 0 marks the text's start
BASE = 257
PER_LANGUAGE = 4000
MAX_GRAMS = 1_600_000
#: bytes turned into grams at a time
SLICE_BYTES = 2_000_000
SCALE = 1 << 20
UNKNOWN = "und"


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; null ids are held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def folded(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def grams(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte with its ``ORDER`` predecessors as one number, the byte last.
    ``starts`` are the places where texts begin."""
    x = data.astype(np.int64) + 1
    out = x.copy()
    for back in range(1, ORDER + 1):
        before = np.zeros(len(x), dtype=np.int64)
        before[back:] = x[:-back]
        for into in range(back):
            at = starts + into
            at = at[at < len(x)]
            before[at] = 0
        out += before * BASE ** back
    return out


def _text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its texts (null: empty)."""
    texts = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _slices(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, grams) of consecutive stretches of the buffer; a stretch is read
    with the ORDER bytes before it, so that a long text is never cut."""
    for at in range(0, len(data), SLICE_BYTES):
        lead = max(0, at - ORDER)
        stop = min(len(data), at + SLICE_BYTES)
        lo, hi = np.searchsorted(offsets, [lead, stop])
        yield at, grams(data[lead:stop], np.unique(offsets[lo:hi]) - lead)[at - lead:]


# --------------------------------------------------------------- training

def gram_counts(sample: DataFrame) -> DataFrame:
    """(lang, gram, n) over the folded texts of the sample, longest order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                keep = pa.array([x == lang for x in langs])
                data, offsets = _text_buffer(batch.column(1).filter(keep))
                for _, g in _slices(data, offsets):
                    found, n = np.unique(g, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], names=["lang", "gram", "n"])

    each = sample.mapInArrow(run, "lang string, gram long, n long")
    return written(each.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(lang, folded text) of the documents that teach: each language's texts of
    lowest hash, at a rate that leaves about ``per_language`` of them."""
    usable = (docs.select(F.col(id_col).alias("lid"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("body"))
              .filter(F.col("lang").isNotNull() & ~held_out(F.col("lid")) & has_letter(F.col("body"))))
    sizes = maybe_broadcast(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("have")), 64)
    chance = F.pmod(F.xxhash64("lid", F.xxhash64("body")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (usable.join(sizes, "lang").filter(chance * F.col("have") < F.lit(float(per_language)))
            .select("lang", folded(F.col("body")).alias("body")))


@dataclass(frozen=True)
class Order:
    """The contexts of one length: symbols by sorted (context, byte) key, and per
    context its totals, also without the bytes already excluded by each longer context."""
    keys: np.ndarray          # context * BASE + byte
    n: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    distinct: np.ndarray
    #: for the contexts of this order: occurrences of their bytes in the context one shorter
    below: np.ndarray


@dataclass(frozen=True)
class Tree:
    orders: list[Order]

    @classmethod
    def of(cls, keys: list[np.ndarray], counts: list[np.ndarray]) -> Tree:
        """From the sorted (context, byte) keys of each order and their counts."""
        orders: list[Order] = []
        for k, (key, n) in enumerate(zip(keys, counts)):
            contexts, first = np.unique(key // BASE, return_index=True)
            total = np.add.reduceat(n, first) if len(first) else np.zeros(0, dtype=np.int64)
            distinct = np.diff(np.concatenate([first, [len(key)]]))
            if k and len(first):
                lower = orders[k - 1]
                # a longer context holds only bytes that the shorter one holds too
                at = np.searchsorted(lower.keys, key % BASE ** k)
                below = np.add.reduceat(lower.n[at], first)
            else:
                below = np.zeros(len(contexts), dtype=np.int64)
            orders.append(Order(key, n, contexts, total, distinct, below))
        return cls(orders)

    def code(self, gram: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte in its context, in 2^-20 bit."""
        bits = np.zeros(len(gram))
        open_ = np.arange(len(gram))                   # grams not coded yet
        gone_n, gone_d = np.zeros(len(gram), dtype=np.int64), np.zeros(len(gram), dtype=np.int64)      # excluded in the present context
        for k in range(len(self.orders) - 1, -1, -1):
            o = self.orders[k]
            if not len(o.keys) or not len(open_):
                continue
            key = gram[open_] % BASE ** (k + 1)
            c = np.minimum(np.searchsorted(o.contexts, key // BASE), len(o.contexts) - 1)
            known = o.contexts[c] == key // BASE
            s = np.minimum(np.searchsorted(o.keys, key), len(o.keys) - 1)
            seen = o.keys[s] == key
            n, d = o.total[c] - gone_n[open_], o.distinct[c] - gone_d[open_]
            # nothing but excluded bytes: the context codes and costs nothing
            live = known & (d > 0)
            cost = np.log2(np.maximum(n + d, 1)) - np.log2(np.maximum(np.where(seen, o.n[s], d), 1))
            bits[open_] += np.where(live, cost, 0.0)
            gone_n[open_] = np.where(known, o.below[c], gone_n[open_])
            gone_d[open_] = np.where(known, o.distinct[c], gone_d[open_])
            open_ = open_[~seen]
        bits[open_] += np.log2(np.maximum(BASE - 1 - gone_d[open_], 1))
        return np.rint(bits * SCALE).astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    langs: list[str]
    trees: list[Tree]

    def code(self, gram: np.ndarray) -> np.ndarray:
        return np.stack([t.code(gram) for t in self.trees])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE,
        max_grams: int = MAX_GRAMS) -> LanguageModel:
    """Context trees of every language that has a usable text."""
    full = gram_counts(training_sample(docs, id_col, text_col, lang_col, per_language))
    every = written(full.select("lang", "n", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.pmod(F.col("gram"), F.lit(BASE ** (k + 1))).alias("key")) for k in range(ORDER + 1)])).alias("g"))
        .groupBy("lang", "g.k", "g.key").agg(F.sum("n").alias("n")), "context_counts")
    # the smallest count at which all orders of a language together keep to its share of max_grams
    sizes: dict[str, list[tuple[int, int]]] = {}
    for lang, n, rows in every.groupBy("lang", "n").count().toLocalIterator():      # about the square root of the sample's bytes
        sizes.setdefault(lang, []).append((n, rows))
    cuts = []
    for lang in sorted(sizes):
        cut, held = max(n for n, _ in sizes[lang]), 0
        for n, rows in sorted(sizes[lang], reverse=True):
            held += rows
            if held > max_grams // len(sizes):
                break
            cut = n
        cuts.append((lang, cut))
    if not cuts:
        return LanguageModel([], [])
    limits = docs.sparkSession.createDataFrame(cuts, "lang string, cut long")       # one row per language
    kept = every.join(F.broadcast(limits), "lang").filter(F.col("n") >= F.col("cut")).select("lang", "k", "key", "n").toArrow()
    lang_of = np.array(kept.column("lang").to_pylist(), dtype=object)
    k_of, key_of, n_of = (kept.column(c).to_numpy().astype(np.int64) for c in ("k", "key", "n"))
    trees = []
    for lang, _ in cuts:
        keys, counts = [], []
        for k in range(ORDER + 1):
            here = np.flatnonzero((lang_of == lang) & (k_of == k))
            here = here[np.argsort(key_of[here], kind="stable")]
            keys.append(key_of[here])
            counts.append(n_of[here])
        trees.append(Tree.of(keys, counts))
    return LanguageModel([lang for lang, _ in cuts], trees)


# --------------------------------------------------------------- scoring

def code_lengths(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code length of every folded text under every language, in 2^-20 bit, and the texts' bytes."""
    data, offsets = _text_buffer(column)
    out = np.zeros((len(model.langs), len(column)), dtype=np.int64)
    text_of = np.repeat(np.arange(len(column)), np.diff(offsets))
    for at, g in _slices(data, offsets):
        found, place = np.unique(g, return_inverse=True)
        code = model.code(found)
        owner = text_of[at:at + len(g)]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        for i in range(len(model.langs)):
            out[i, owner[first]] += np.add.reduceat(code[i][place], first)
    return out, np.diff(offsets)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)      # at most MAX_GRAMS grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in batches:
            letters = batch.column(2).to_numpy(zero_copy_only=False)
            n = batch.num_rows
            pred, score, rate = np.full(n, UNKNOWN, dtype=object), np.zeros(n), np.zeros(n)
            if made.langs:
                lengths, size = code_lengths(made, batch.column(3))
                best = lengths.argmin(axis=0)
                short = lengths[best, np.arange(n)]
                share = 1 / np.exp2(-np.minimum((lengths - short) / SCALE, 1000.0)).sum(axis=0)
                pred[letters], score[letters] = np.array(made.langs, dtype=object)[best[letters]], share[letters]
                rate[letters] = short[letters] / SCALE / np.maximum(size[letters], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)],
                                             names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), has_letter(text).alias("letters"),
                       folded(text).alias("body")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double")


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fit on the rows that teach and identify every row."""
    return identify(docs, fit(docs, id_col, text_col, lang_col, per_language), id_col, text_col)
