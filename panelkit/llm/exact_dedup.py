"""Exact de-duplication against immutable snapshots screened by binary-fuse filters.

The rows arrive in batches. After a batch is settled, its new texts become an
immutable snapshot: a table of exact buckets (digest -> count, staying row) and
one static binary-fuse filter per shard of digests (``fuse.py``). For the next
batch

1. duplicates inside the batch are grouped on their digest (partial
   aggregation, so a hot text moves one row per task);
2. the distinct digests are screened by one snapshot's filters after the
   other, shard by shard, a shard's digests spread over salts; a negative
   answer is certain;
3. positives join the exact buckets on the full digest (a filter's false
   positives find nothing); only digests not found go on to the next snapshot,
   and those found in none are new;
4. at the end every member of a group is compared byte for byte with the text
   that stays. Texts whose digests collide are regrouped on the text itself.

Only digests move, except for the texts of rows in groups of two or more. A
group of any size is spread over salts, so no task holds a whole group.

Defined results: a null text counts as empty, equal to ''. Of equal texts the
row with the largest id stays; null ids rank last. Rows repeated with equal id
and text all count in ``group_size`` and exactly one of them is kept. An empty
table gives an empty result. Other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkit.llm import fuse
from panelkit.llm.common import maybe_broadcast, text_or_empty, written

#: digests per filter shard: bounds what one task builds or tests
SHARD_KEYS = 200_000
#: a group of more rows is hot; there are never more hot groups than HOT_GROUPS
HOT_ROWS = 20_000
HOT_GROUPS = 200_000
#: texts of one group that are compared in one place
SALT_ROWS = 512
MAX_SALTS = 4096

_FILTER = "shard int, seed decimal(20,0), seg int, count int, table binary"


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _key(digest: str) -> Column:
    return F.xxhash64(F.col(digest))


def _shard(key: str, shards: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.col(key), 20), F.lit(shards)).cast("int")


def build_filters(buckets: DataFrame, shards: int) -> DataFrame:
    """One binary-fuse filter per shard of a snapshot's digests."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        f = fuse.build(pdf["k"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "seed": [f["seed"]], "seg": [f["seg"]],
                             "count": [f["count"]], "table": [f["table"]]}).astype({"seed": object})

    def decimals(pdf: pd.DataFrame) -> pd.DataFrame:
        from decimal import Decimal
        out = build(pdf)
        out["seed"] = [Decimal(int(x)) for x in out["seed"]]
        return out

    keyed = buckets.select(_key("digest").alias("k"))
    return keyed.withColumn("shard", _shard("k", shards)).groupBy("shard").applyInPandas(decimals, _FILTER)


def screen(digests: DataFrame, filters: DataFrame, shards: int, salts: int = 1) -> DataFrame:
    """The rows of ``digests`` (distinct) that the snapshot may hold. Each
    shard's digests are tested in ``salts`` groups, its filter in each of them."""
    fields = digests.schema.fieldNames()

    def test(rows: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(f):
            return rows.iloc[:0][fields]
        one = {"seed": int(f["seed"].iloc[0]), "seg": f["seg"].iloc[0], "count": f["count"].iloc[0],
               "table": f["table"].iloc[0]}
        return rows[fuse.contains(one, rows["k"].to_numpy(np.int64).view(np.uint64))][fields]

    keyed = digests.withColumn("k", _key("digest")).withColumn("shard", _shard("k", shards))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(salts)).cast("int"))
    each = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return keyed.groupBy("shard", "salt").cogroup(each.groupBy("shard", "salt")).applyInPandas(test, digests.schema)


def arrival_batch(id_col: Column, batches: int) -> Column:
    """A fixed pseudo-random arrival batch per id (null ids: batch 0)."""
    return F.coalesce(F.pmod(F.xxhash64(id_col), F.lit(batches)), F.lit(0)).cast("int")


def exact_groups(rows: DataFrame, batches: int) -> DataFrame:
    """(digest, n, keep_id) of every digest of ``rows`` (doc_id, digest, batch),
    settled batch by batch against the snapshots before it."""
    snapshots: list[tuple[DataFrame, DataFrame, int]] = []
    hits: DataFrame | None = None
    for b in range(batches):
        new = (rows.filter(F.col("batch") == b).groupBy("digest")
               .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id")))
        if snapshots:
            new = written(new, f"batch{b}")
            left = new.count()
            for buckets, filters, shards in snapshots:
                if not shards or not left:
                    continue
                positive = screen(new, filters, shards, max(1, -(-left // (shards * SHARD_KEYS))))
                known = written(positive.join(buckets.select("digest"), "digest", "left_semi"), f"known{b}")
                hits = known if hits is None else hits.unionByName(known)
                new = new.join(known.select("digest"), "digest", "left_anti")
                left -= known.count()
        buckets = written(new, f"snapshot{b}")
        shards = -(-buckets.count() // SHARD_KEYS)
        filters = written(build_filters(buckets, shards), f"filter{b}") if shards and b < batches - 1 else None
        snapshots.append((buckets, filters, shards))
    out = snapshots[0][0]
    for buckets, _, _ in snapshots[1:]:
        out = out.unionByName(buckets)
    if hits is None:
        return out
    later = hits.groupBy("digest").agg(F.sum("n").alias("n2"), F.max("keep_id").alias("keep2"))
    return (out.join(later, "digest", "left")
            .select("digest", (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"),
                    F.greatest("keep_id", "keep2").alias("keep_id")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3,
                digest: Callable[[Column], Column] = sha256_hex) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, digest.

    ``digest`` may be any deterministic function of the text; equality is
    decided on the bytes.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = written(plain.select("doc_id", digest(F.col("text")).alias("digest"),
                                arrival_batch(F.col("doc_id"), batches).alias("batch")), "digests")
    groups = exact_groups(rows, batches)
    multi = written(groups.filter("n > 1").select("digest", "n", "keep_id"), "groups")
    grouped = written(_with_groups(rows, multi), "grouped")
    singles = (grouped.filter("n is null")
               .select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                       F.lit(True).alias("kept"), "digest"))
    return singles.unionByName(_byte_check(plain, grouped.filter("n is not null"), digest))


def _with_groups(rows: DataFrame, multi: DataFrame) -> DataFrame:
    """doc_id, digest and the figures (n, keep_id) of the row's group, null where it is alone.

    Groups of more than ``cut`` rows are at most ``HOT_GROUPS`` by count, so
    they are broadcast; the others are joined by a shuffle in which no digest
    has more than ``cut`` rows.
    """
    cut = max(HOT_ROWS, rows.count() // HOT_GROUPS)
    plain = rows.select("doc_id", "digest")
    hot = F.broadcast(multi.filter(F.col("n") > cut))
    in_hot = plain.join(hot, "digest")
    rest = plain.join(hot.select("digest"), "digest", "left_anti")
    in_cold = rest.join(multi.filter(F.col("n") <= cut), "digest", "left")
    return in_hot.select("doc_id", "digest", "n", "keep_id").unionByName(in_cold.select("doc_id", "digest", "n", "keep_id"))


def _byte_check(plain: DataFrame, members: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Compare each member's bytes with those of the row that stays."""
    side = maybe_broadcast(members.select("doc_id", "digest", "n", "keep_id").distinct(), 120)
    hashed = plain.withColumn("digest", digest(F.col("text")))
    same_doc = hashed["doc_id"].eqNullSafe(side["doc_id"]) & (hashed["digest"] == side["digest"])
    parts = F.least(F.lit(MAX_SALTS), F.ceil(F.col("n") / SALT_ROWS)).cast("int")
    texts = written(hashed.join(side, same_doc).select(hashed["doc_id"], hashed["digest"], "text", "n", "keep_id")
                    .withColumns({"salts": parts, "row": F.monotonically_increasing_id()}), "texts")
    # the text that stays, once per salt of its group
    kept_text = (texts.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "salts").agg(F.max("text").alias("kept_text"))
                 .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))))
    salted = texts.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    compared = salted.join(kept_text.drop("salts"), ["digest", "salt"], "left")
    differing = written(compared.filter(~F.col("text").eqNullSafe(F.col("kept_text"))).select("digest").distinct(), "differing")
    settled = _marked(texts.join(differing, "digest", "left_anti"), ["digest"])
    if differing.isEmpty():
        return settled
    mixed = texts.drop("n", "keep_id").join(differing, "digest", "left_semi")
    by_text = mixed.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep_id"))
    return settled.unionByName(_marked(mixed.join(by_text, ["digest", "text"]), ["digest", "text"]))


def _marked(rows: DataFrame, group: list[str]) -> DataFrame:
    """The result's columns; of the rows that hold their group's ``keep_id`` the
    one of the smallest row number is kept. That row is found by an aggregate and
    joined by its own number, so rows repeated any number of times spread."""
    first = (rows.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy(*group)
             .agg(F.min("row").alias("first")).select("first"))
    return rows.join(first, F.col("row") == F.col("first"), "left").select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("first").isNotNull().alias("kept"), "digest")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows repeated
    with equal id and text any one."""
    decided = exact_dedup(docs, id_col, text_col, batches).filter("group_size > 1")
    keys = written(decided.groupBy(F.col("doc_id").alias("_key_id"), F.col("digest").alias("_key_digest"))
                   .agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("copies")), "decided")
    side = maybe_broadcast(keys.filter("not stays").select("_key_id", "_key_digest"), 100)
    tagged = docs.withColumn("_digest", sha256_hex(text_or_empty(text_col)))
    same = F.col(id_col).eqNullSafe(F.col("_key_id")) & (F.col("_digest") == F.col("_key_digest"))
    left = tagged.join(side, same, "left_anti")
    repeated = keys.filter("stays and copies > 1").select("_key_id", "_key_digest")
    n_repeated = repeated.count()
    if not n_repeated:
        return left.drop("_digest")
    names = docs.columns
    twice = maybe_broadcast(repeated, 100, n_repeated)
    # an aggregate, not a window: the copies of one row may be a third of all rows
    once = left.join(twice, same, "left_semi").groupBy(F.col(id_col).alias("_i"), "_digest").agg(F.first(F.struct(*names)).alias("_row"))
    return left.join(twice, same, "left_anti").select(*names).unionByName(once.select("_row.*"))
