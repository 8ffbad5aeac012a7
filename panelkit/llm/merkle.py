"""Document fingerprints: Merkle trees over paragraphs and sections.

Leaves are paragraphs: lines, with long lines cut every ``LEAF_WORDS`` words;
their concatenation is the text. A section is a run of paragraphs that ends
after one whose hash is divisible by ``SECTION_MEAN``, so its borders move with
the content and an insertion disturbs only its own section. A section's digest
hashes its paragraphs' digests, the root hashes the sections' digests (SHA-256
throughout): equal texts have equal roots, and unequal sections, then unequal
paragraphs inside them, locate an edit.

The fingerprint string is the root and, per section, the head of its digest
and those of its paragraphs: ``root;section:leaf,leaf|section:leaf``. The
likeness of two fingerprints is 1 for equal roots, else twice the paragraphs
in common over those of both (0 to 1).

The query's "next document" is found with bounded windows. The ids and text
hashes alone are range-partitioned into blocks of about ``BLOCK_ROWS`` rows
(more only beyond ``MAX_BLOCKS`` blocks), wherever the ids lie; each text goes
to its block by binary search in the blocks' first keys, a block also receives
the row next to its end, and no window holds more than a block. Rows repeated
with equal id and text travel as one.

Only DataFrame functions are used. Defined results: a null text counts as
empty; the empty text has no sections and the root of the empty string; two
empty texts have likeness 1, an empty and another 0. Rows are ordered by
descending id, null ids last, equal ids by descending SHA-256 of the text. A
single row is its own next.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelkit.llm.common import maybe_broadcast, text_or_empty, written

LEAF_WORDS = 6
SECTION_MEAN = 8
BLOCK_ROWS = 2048
MAX_BLOCKS = 65_536
HEAD = 12                       # hex digits kept of a digest below the root

_LEAF = r"\s++|(?:\S++[^\S\n]*+){1,%d}\n*+" % LEAF_WORDS


def leaf_digests(text: Column) -> Column:
    """SHA-256 of each paragraph, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(_LEAF), F.lit(0)), lambda p: F.sha2(p.cast("binary"), 256))


def section_ends(leaves: Column) -> Column:
    """Numbers (from 1) of the leaves that end a section."""
    n = F.size(leaves)
    last = F.filter(F.sequence(F.lit(1), n), lambda i: F.pmod(F.xxhash64(F.get(leaves, i - 1)), F.lit(SECTION_MEAN)) == 0)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(last, F.array(n))))


def sections(leaves: Column, ends: Column) -> Column:
    """Arrays of the leaf digests of each section."""
    starts = F.concat(F.array(F.lit(0)), ends)
    return F.zip_with(F.slice(starts, 1, F.size(ends)), ends, lambda a, e: F.slice(leaves, a + 1, e - a))


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds <prefix>_leaves (heads) and <prefix>_fp (the fingerprint string)."""
    leaves, ends, parts, digests = (f"{prefix}_{x}" for x in ("full", "ends", "sections", "digests"))
    out = df.withColumn(leaves, leaf_digests(F.col(text)))
    # a column of its own: inside the next one's function it would be computed per section
    out = out.withColumn(ends, section_ends(F.col(leaves)))
    out = out.withColumn(parts, sections(F.col(leaves), F.col(ends)))
    out = out.withColumn(digests, F.transform(parts, lambda s: F.sha2(F.array_join(s, "").cast("binary"), 256)))
    shown = F.zip_with(digests, parts, lambda d, s: F.concat(
        F.substring(d, 1, HEAD), F.lit(":"), F.array_join(F.transform(s, lambda x: F.substring(x, 1, HEAD)), ",")))
    root = F.sha2(F.array_join(digests, "").cast("binary"), 256)
    out = out.withColumn(f"{prefix}_fp", F.concat(root, F.lit(";"), F.array_join(shown, "|")))
    return out.withColumn(f"{prefix}_leaves", F.transform(leaves, lambda x: F.conv(F.substring(x, 1, HEAD), 16, 10).cast("long"))) \
        .drop(leaves, ends, parts, digests)


def root_of(fp: Column) -> Column:
    return F.substring(fp, 1, 64)


def likeness(fp_a: Column, leaves_a: Column, fp_b: Column, leaves_b: Column) -> Column:
    common = F.size(F.array_intersect(leaves_a, leaves_b))
    both = F.size(F.array_distinct(leaves_a)) + F.size(F.array_distinct(leaves_b))
    return F.when(root_of(fp_a) == root_of(fp_b), F.lit(1.0)).otherwise(2.0 * common / both)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint per row."""
    plain = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return with_tree(plain, "text", "own").select("doc_id", F.col("own_fp").alias("fingerprint"))


def locate_edits(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """For rows with two fingerprint strings: ``changed`` lists the sections of
    ``after`` not found in ``before`` as (section number, paragraph numbers);
    empty for equal roots. Numbers start at 0."""
    body = lambda c: F.filter(F.split(F.substring_index(F.col(c), ";", -1), r"\|"), lambda s: s != "")
    split = pairs.withColumn("_old", body(before)).withColumn("_new", body(after))
    old_leaves = F.flatten(F.transform("_old", lambda s: F.split(F.substring_index(s, ":", -1), ",")))
    split = split.withColumn("_old_leaves", old_leaves)
    numbered = F.transform("_new", lambda s, k: F.struct(
        k.alias("section"), s.alias("body"), F.split(F.substring_index(s, ":", -1), ",").alias("leaves")))
    differing = F.filter(numbered, lambda x: ~F.array_contains("_old", x["body"]))
    changed = F.transform(differing, lambda x: F.struct(x["section"].alias("section"), F.filter(
        F.transform(x["leaves"], lambda p, i: F.when(~F.array_contains("_old_leaves", p), i)), lambda i: i.isNotNull()).alias("paragraphs")))
    same = root_of(F.col(before)) == root_of(F.col(after))
    return split.withColumn("changed", F.when(same, F.slice(changed, 1, 0)).otherwise(changed)).drop("_old", "_new", "_old_leaves")


def block_starts(keys: DataFrame, n: int) -> DataFrame:
    """One row: ``starts``, the first (doc_id, th) of each block of the ``n`` distinct ``keys``, in order."""
    blocks = max(1, min(MAX_BLOCKS, n // BLOCK_ROWS))
    dealt = keys.repartitionByRange(blocks, F.col("doc_id").asc_nulls_first(), F.col("th"))
    firsts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("doc_id", "th")).alias("first"))
    # at most MAX_BLOCKS entries
    return written(firsts.agg(F.sort_array(F.collect_list("first")).alias("starts")), "block_starts")


def with_block(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` (doc_id, th, ...) with the number ``at`` of their block."""
    key = F.struct("doc_id", "th")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(MAX_BLOCKS.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("starts", at + step) <= key, at + step).otherwise(at))
    # one row on that side
    return rows.join(F.broadcast(starts)).withColumn("at", found).drop("starts")


def merged_repeats(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (doc_id, th, text) with the number ``n`` of rows of equal id and text, once each."""
    repeats = written(keys.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeats")
    count = repeats.count()
    if not count:
        return rows.withColumn("n", F.lit(1).cast("long"))
    side = maybe_broadcast(repeats.select(F.col("doc_id").alias("rid"), F.col("th").alias("rth"), "n"), 120, count)
    same = rows["doc_id"].eqNullSafe(side["rid"]) & (rows["th"] == side["rth"])
    alone = rows.join(side, same, "left_anti").withColumn("n", F.lit(1).cast("long"))
    merged = rows.join(side, same).groupBy("doc_id", "th").agg(F.any_value("text").alias("text"), F.max("n").alias("n"))
    return alone.unionByName(merged)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with the text of the next row by descending id
    (after the last: the first)."""
    rows = docs.withColumn("th", F.sha2(F.col("text").cast("binary"), 256))
    keys = written(rows.select("doc_id", "th"), "keys")
    one = keys.distinct()
    n = one.count()
    if not n:
        return docs.withColumn("next_text", F.lit(None).cast("string"))
    starts = block_starts(one, n)
    # at most MAX_BLOCKS rows; a block's last key is the next of the first key of the block above
    heads = with_block(one, starts).groupBy("at").agg(F.max(F.struct("doc_id", "th")).alias("head"))
    above = F.coalesce(F.lead("at").over(Window.orderBy("at")), F.min("at").over(Window.partitionBy()))
    heads = written(heads.select(F.col("at").alias("b"), "head", above.alias("to_block")), "heads")
    blocked = with_block(merged_repeats(rows, keys), starts)
    last = (F.col("at") == F.col("b")) & (F.col("head.th") == F.col("th")) & F.col("head.doc_id").eqNullSafe(F.col("doc_id"))
    marked = blocked.join(F.broadcast(heads), last, "left")
    home = F.struct(F.lit(False).alias("guest"), F.col("at").alias("block"))
    away = F.struct(F.lit(True).alias("guest"), F.col("to_block").alias("block"))
    places = F.when(F.col("b").isNull(), F.array(home)).otherwise(F.array(home, away))
    placed = marked.withColumn("p", F.explode(places)).select("doc_id", "th", "text", "n", "p.guest", "p.block")
    # the guest stands before the block's first key, also where it comes round from the highest one
    inside = Window.partitionBy("block").orderBy(F.col("guest").desc(), F.col("doc_id").asc_nulls_first(), "th")
    following = placed.withColumn("next_text", F.lag("text").over(inside)).filter("not guest")
    # of repeated rows all but one are followed by their like
    each = following.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return each.select("doc_id", "text", F.when(F.col("copy") == 1, F.col("next_text")).otherwise(F.col("text")).alias("next_text"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row."""
    plain = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(plain).withColumn("edited", edited)
    rows = with_tree(with_tree(with_tree(rows, "text", "own"), "edited", "edit"), "next_text", "next")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("own_fp").alias("fingerprint"), F.col("edit_fp").alias("edited_fingerprint"),
        likeness(F.col("own_fp"), F.col("own_leaves"), F.col("edit_fp"), F.col("edit_leaves")).alias("near_edited"),
        likeness(F.col("own_fp"), F.col("own_leaves"), F.col("next_fp"), F.col("next_leaves")).alias("near_next"))
