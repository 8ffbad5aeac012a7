import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from panelkit.llm import exact_dedup as X
from panelkit.llm import fuse
from panelkit.llm.queries import op2_exact_dedup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 60_000])
def test_fuse_filter_has_no_false_negatives(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.uint64)
    f = fuse.build(np.concatenate([keys, keys]))
    assert fuse.contains(f, keys).all()
    assert fuse.contains(f, rng.integers(0, 2**63, 50_000, dtype=np.uint64)).mean() < 1e-3


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_query_matches_brute_force(spark, small_rows):
    assert rows_of(op2_exact_dedup(spark, SF)) == brute.exact([(i, t) for i, t, _ in small_rows])


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_edge_cases(edge_docs, batches):
    want = brute.exact([(r.doc_id, r.text) for r in edge_docs.collect()])
    assert rows_of(X.exact_dedup(edge_docs, batches=batches)) == want


def test_colliding_digests_are_told_apart_by_bytes(edge_docs):
    weak = X.exact_dedup(edge_docs, digest=lambda t: F.substring(X.sha256_hex(t), 1, 1))
    want = [r[:4] for r in brute.exact([(r.doc_id, r.text) for r in edge_docs.collect()])]
    assert sorted([tuple(r)[:4] for r in weak.collect()], key=str) == sorted(want, key=str)


def test_hot_group_is_salted(spark, monkeypatch):
    monkeypatch.setattr(X, "SALT_ROWS", 7)
    monkeypatch.setattr(X, "HOT_ROWS", 50)
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), (F.col("id") % 50).cast("string"))).alias("text"))
    assert rows_of(X.exact_dedup(docs)) == brute.exact([tuple(r) for r in docs.collect()])


def test_empty_table(no_docs):
    assert X.exact_dedup(no_docs).count() == 0
    assert X.keep_first(no_docs).columns == no_docs.columns


def test_keep_first_keeps_one_of_each_text(edge_docs):
    kept = X.keep_first(edge_docs)
    assert kept.columns == edge_docs.columns
    want = sorted((r[0], r[4]) for r in brute.exact([(r.doc_id, r.text) for r in edge_docs.collect()]) if r[3])
    assert sorted((r.doc_id, brute.sha(r.text or "")) for r in kept.collect()) == want


def test_screened_groups_are_bounded(spark, monkeypatch):
    """Snapshots much smaller than the batches screened against them."""
    monkeypatch.setattr(X, "SHARD_KEYS", 40)
    real, sizes, rows = X.screen, [], []

    def screen(digests, filters, shards, salts=1):
        k = F.xxhash64("digest")
        shard = F.pmod(F.shiftrightunsigned(k, 20), F.lit(shards))
        groups = digests.groupBy(shard, F.pmod(F.xxhash64(k), F.lit(salts))).count()
        sizes.extend(r["count"] for r in groups.collect())
        rows.append(digests.count())
        return real(digests, filters, shards, salts) if salts != 1 else real(digests, filters, shards)

    monkeypatch.setattr(X, "screen", screen)
    # batch 0 holds 2 texts, batch 1 these and 600 more, batch 2 the 602 again
    text = [(i % 2, 0) for i in range(50)] + [(i, 1) for i in range(602)] + [(i, 2) for i in range(602)]
    docs = spark.createDataFrame([(k, f"t{i}", b) for k, (i, b) in enumerate(text)], "doc_id long, text string, batch int")
    plain = docs.select("doc_id", X.sha256_hex(F.col("text")).alias("digest"), "batch")
    got = {r.digest: (r.n, r.keep_id) for r in X.exact_groups(plain, 3).collect()}
    assert got == {brute.sha(f"t{i}"): (27 if i < 2 else 2, 652 + i) for i in range(602)}
    assert rows == [602, 602, 600]                  # what the first snapshot holds is not asked of the second
    assert max(sizes) <= 2 * X.SHARD_KEYS           # hashed spread about SHARD_KEYS


def test_empty_snapshots_are_skipped(spark):
    docs = spark.createDataFrame([(k, f"t{k % 30}", 1 + k % 2) for k in range(90)], "doc_id long, text string, batch int")
    plain = docs.select("doc_id", X.sha256_hex(F.col("text")).alias("digest"), "batch")
    assert sorted(r.n for r in X.exact_groups(plain, 3).collect()) == [3] * 30


def test_repeated_rows_stay_once_without_a_window(spark):
    rows = [(7, "same", k) for k in range(3000)] + [(None, "none", k) for k in range(500)] + [(None, "same", 0), (8, "other", 1), (6, "same", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(8)
    kept = X.keep_first(docs)
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == [(7, "same"), (8, "other"), (None, "none")]
    assert "Window" not in kept._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_and_null_ids_spread(spark, monkeypatch):
    monkeypatch.setattr(X, "SALT_ROWS", 100)
    rows = spark.range(6000).select(F.when(F.col("id") < 3000, F.lit(7)).when(F.col("id") % 2 == 0, F.col("id")).alias("doc_id"),
                                    F.when(F.col("id") < 4000, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 40)).alias("text"))
    out = X.exact_dedup(rows)
    assert "Window" not in out._jdf.queryExecution().toString()
    assert rows_of(out) == brute.exact([tuple(r) for r in rows.collect()])
