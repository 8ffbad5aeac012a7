"""SimHash near-duplicates by anchor-point covering.

Fingerprint: a bit is 1 if more than half of the shingles' 64-bit hashes have
it. Two fingerprints link at ``max_bits`` or fewer differing bits.

Covering. The 64 bits are cut into two halves; of a pair at distance 2 one
half differs by at most 1. Each half is 31 bits that carry the Hamming
[31, 26] code plus one bit more. That code is perfect: its words (the anchors)
cover the 31-bit space with radius 1. A fingerprint is replicated to every
anchor within covering radius + threshold = 1 + 1 of its half: a pair within
the threshold on a half shares the anchor nearest to either member, so no link
is lost. That is 1 or 16 anchors per half. Inside an anchor's group the
members are compared on all 64 bits.

Distinct fingerprints are compared, not documents, so a group of equal copies
is one row. Within a group only a spanning forest of its links leaves the
task, never all pairs. Large groups are split by the other half's bits in
three parts, one of which is equal for any pair (pigeonhole), and within a
task a group is compared in blocks, or by probing all neighbours of each
fingerprint when that is less work; both give the same links.
Components are found by alternating large-star and small-star steps on the
links between fingerprints.

Defined results: only A-Z is lower-cased; fewer words than a shingle make one
shingle of all of them; a null, empty or blank text has fingerprint 0, which
links like any other. component_id is the smallest id reachable; null ids keep
their row and take part in the component under the smallest non-null id (null
only where no id is known). Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm.common import maybe_broadcast, text_or_empty, written
from panelkit.llm.exact_dedup import sha256_hex

SHINGLE = 3
MAX_BITS = 2
#: an anchor's group of more distinct fingerprints than this is split
SPLIT_ROWS = 4096
#: a hot node's or fingerprint's rows are spread over so many join keys
SALTS = 16


# ---- fingerprints -----------------------------------------------------------

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()     # ASCII lower case and blanks only
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 65_536):
        part = np.unpackbits(h[i:i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in text], dtype=np.uint64).view(np.int64))
    return fp(F.col(text_col))


# ---- covering ---------------------------------------------------------------

@functools.cache
def _partners() -> np.ndarray:
    """For a position p (1..31) of the Hamming code, the pairs {a, b} with
    p ^ a ^ b = 0 as 31-bit masks of {a, b}: row p has 15 of them."""
    out = np.zeros((32, 15), dtype=np.uint32)
    for p in range(1, 32):
        pairs = [(a, p ^ a) for a in range(1, 32) if a < p ^ a]
        out[p] = [(1 << (a - 1)) | (1 << (b - 1)) for a, b in pairs]
    return out


def syndrome(x: np.ndarray) -> np.ndarray:
    """Position (1..31) of the bit that leads to the nearest code word; 0 for a code word."""
    s = np.zeros(len(x), dtype=np.uint32)
    for p in range(1, 32):
        s ^= ((x >> np.uint32(p - 1)) & np.uint32(1)) * np.uint32(p)
    return s


def anchors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All code words within distance 2 of each 31-bit word: (row, code word)."""
    s = syndrome(x)
    off = s > 0
    near = np.where(off, x ^ (np.uint32(1) << (np.maximum(s, 1) - np.uint32(1))), x)
    rows = np.flatnonzero(off)
    # a word two flips away has the syndrome p = a ^ b of the flipped pair
    far = x[rows, None] ^ _partners()[s[rows]]
    return np.concatenate([np.arange(len(x)), np.repeat(rows, 15)]), np.concatenate([near, far.ravel()])


def half(fp: np.ndarray, which: int) -> np.ndarray:
    return ((fp >> np.uint64(32 * which)) & np.uint64(0x7FFFFFFF)).astype(np.uint32)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            fp = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False).view(np.uint64)
            for which in (0, 1):
                row, word = anchors(half(fp, which))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word.astype(np.int64) | (which << 40)), pa.array(fp[row].view(np.int64))], names=["anchor", "fp"])


def _forest(fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one group of distinct fingerprints."""
    n = len(fp)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left, right = [], []

    def link(a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist()):
            ri, rj = find(i), find(j)
            if ri != rj:
                parent[max(ri, rj)] = min(ri, rj)
                left.append(i)
                right.append(j)

    if n <= 8192:
        for i in range(0, n, 256):
            d = np.bitwise_count(fp[i:i + 256, None] ^ fp[None, i:])
            a, b = np.nonzero(d <= max_bits)
            later = a < b
            link(a[later] + i, b[later] + i)
    else:
        order = np.argsort(fp)
        ranked = fp[order]
        one = np.uint64(1) << np.arange(64, dtype=np.uint64)
        masks = [np.concatenate([one[k + 1:] ^ one[k], one[k:k + 1]]) for k in range(64)]
        for group in masks:
            for m in group:
                probe = fp ^ m
                at = np.minimum(np.searchsorted(ranked, probe), n - 1)
                hit = np.flatnonzero(ranked[at] == probe)
                other = order[at[hit]]
                once = hit < other
                link(hit[once], other[once])
    return fp[np.array(left, dtype=np.int64)], fp[np.array(right, dtype=np.int64)]


def _grouped_links(max_bits: int):
    """mapInPandas body over rows sorted by group key: emits each group's forest.
    A group may span batches; only the open group is held."""
    def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a ^ b) <= max_bits
        found = [(a[near], b[near])]
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
            found.append(_forest(fp[s:s + n], max_bits))
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def frame(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        a, b = links(key, fp)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, open_fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        for pdf in batches:
            key = np.concatenate([open_key, pdf["key"].to_numpy()])
            fp = np.concatenate([open_fp, pdf["fp"].to_numpy().view(np.uint64)])
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield frame(key[:last], fp[:last])
            open_key, open_fp = key[last:], fp[last:]
        if len(open_key) > 1:
            yield frame(open_key, open_fp)
    return run


def near_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a < b, as signed numbers) that connect every pair of the distinct
    ``fps`` (one column fp) within ``max_bits``; at most a forest per group."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the covering is laid out for a threshold of at most 2 bits")
    spread = fps.select("fp").mapInArrow(_replicate, "anchor long, fp long")
    sizes = spread.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    hot = written(sizes.filter(F.col("n") > SPLIT_ROWS).select("anchor", F.lit(True).alias("hot")), "hot_anchors")
    inside = spread.join(maybe_broadcast(hot, 24), "anchor", "left")
    other = F.when(F.shiftright("anchor", 40) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    parts = F.array(*[F.struct(F.lit(k).alias("part"), F.shiftright(other, s).bitwiseAND(m).alias("bits"))
                      for k, (s, m) in enumerate(((0, 0x7FF), (11, 0x7FF), (22, 0x3FF)), 1)])
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("bits")))
    keyed = inside.withColumn("p", F.explode(F.when(F.col("hot"), parts).otherwise(whole)))
    keyed = keyed.select(F.xxhash64("anchor", "p.part", "p.bits").alias("key"), "fp")
    found = keyed.repartition("key").sortWithinPartitions("key").mapInPandas(_grouped_links(max_bits), "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# ---- components -------------------------------------------------------------

def _with_low(edges: DataFrame, low: DataFrame) -> DataFrame:
    """Join each edge to the low of its u; a hot u is spread over salts."""
    salted = low.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"])


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): for each node of the links the smallest node reachable.
    Alternates large-star and small-star until nothing changes; each round is
    written, so lineage stays short."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = _with_low(both, low).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (_with_low(large, low2).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low2.select("u", F.col("m").alias("v")))).distinct()
        edges = written(small, "star")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            found = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
            tops = found.select("root").distinct()
            return found.unionByName(tops.select(F.col("root").alias("node"), "root")).distinct()
        state = now
    raise RuntimeError("components did not settle")


def _lookup(base: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, component_id, members) per distinct fingerprint of ``base``;
    root names the component, also where no id is known, members counts its rows."""
    classes = base.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    roots = components(near_links(classes, max_bits))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id", "n")
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.sum("n").alias("members"))
    return written(rooted.join(firsts, "root").select("fp", "root", "component_id", "members"), "components")


def _with_component(base: DataFrame, lookup: DataFrame) -> DataFrame:
    """``base`` joined to the lookup; equal fingerprints may be a third of all rows, so they are salted."""
    salted = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["fp", "salt"])


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row of ``docs``."""
    base = written(docs.select(F.col(id_col).alias("doc_id"), with_fingerprints(docs, text_col, shingle).alias("fp")), "simhash")
    return _with_component(base, _lookup(base, max_bits)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component, unchanged: that of the smallest id
    (null ids last), of several texts of that id the one of the smallest
    digest, of rows repeated with equal id and text any one.

    Rows are told apart by id and text digest: an id may be null or stand with
    several texts, in several components."""
    digest = sha256_hex(text_or_empty(text_col))
    base = written(docs.select(F.col(id_col).alias("doc_id"), with_fingerprints(docs, text_col).alias("fp"), digest.alias("digest")), "simhash")
    shared = _lookup(base, MAX_BITS).filter("members > 1").select("fp", "root")
    members = written(_with_component(base, shared).select("doc_id", "digest", "root"), "near_members")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    first = members.groupBy("root").agg(F.min(order).alias("f")).select(F.col("f.doc_id").alias("_id"), F.col("f.digest").alias("_first"))
    keys = members.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    decided = keys.join(first, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_first")), "left")
    decided = written(decided.select(F.col("doc_id").alias("_key_id"), F.col("digest").alias("_key_digest"), "copies",
                                     F.col("_first").isNotNull().alias("stays")), "near_decided")
    tagged = docs.withColumn("_digest", digest)
    same = F.col(id_col).eqNullSafe(F.col("_key_id")) & (F.col("_digest") == F.col("_key_digest"))
    gone = maybe_broadcast(decided.filter("not stays").select("_key_id", "_key_digest"), 100)
    left = tagged.join(gone, same, "left_anti")
    repeated = decided.filter("stays and copies > 1").select("_key_id", "_key_digest")
    n_repeated = repeated.count()
    if not n_repeated:
        return left.drop("_digest")
    names = docs.columns
    side = maybe_broadcast(repeated, 100, n_repeated)
    # an aggregate, not a window: the copies of one row may be a third of all rows
    once = left.join(side, same, "left_semi").groupBy(F.col(id_col).alias("_i"), "_digest").agg(F.first(F.struct(*names)).alias("_row"))
    return left.join(side, same, "left_anti").select(*names).unionByName(once.select("_row.*"))
