import random

import numpy as np
import pytest

import brute
from panelkit.llm import simhash as S
from panelkit.llm.queries import op10_simhash_near_dedup

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_query_matches_brute_force(spark, small_rows):
    assert rows_of(op10_simhash_near_dedup(spark, SF)) == brute.near_components([(i, t) for i, t, _ in small_rows])


def test_edge_cases(edge_docs):
    assert rows_of(S.near_dedup(edge_docs)) == brute.near_components([(r.doc_id, r.text) for r in edge_docs.collect()])


def test_every_pair_within_two_bits_shares_an_anchor():
    rng = random.Random(5)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        both = np.array([x, y], dtype=np.uint64)
        shared = False
        for which in (0, 1):
            row, word = S.anchors(S.half(both, which))
            shared |= bool(set(word[row == 0]) & set(word[row == 1]))
        assert shared


def test_anchors_are_code_words_within_two_bits():
    x = np.random.default_rng(0).integers(0, 2**31, 400, dtype=np.uint32)
    row, word = S.anchors(x)
    assert not S.syndrome(word).any()
    assert np.bitwise_count(x[row] ^ word).max() <= 2
    assert set(np.bincount(row)) <= {1, 16}


@pytest.mark.parametrize("split", [4096, 3])
def test_links_connect_planted_clusters(spark, monkeypatch, split):
    """Chains of near fingerprints, with hot anchors split and not."""
    monkeypatch.setattr(S, "SPLIT_ROWS", split)
    rng = random.Random(1)
    fps = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fps.add(x)
            x ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    roots = S.components(S.near_links(spark.createDataFrame(signed, "fp long"))).collect()
    got = {}
    for r in roots:
        got.setdefault(r.root, set()).add(r.node % (1 << 64))
    nodes, want = sorted(fps), []
    todo = set(nodes)
    while todo:
        group, stack = set(), [todo.pop()]
        while stack:
            f = stack.pop()
            group.add(f)
            near = {g for g in todo if (f ^ g).bit_count() <= 2}
            todo -= near
            stack += near
        want.append(group)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want if len(g) > 1)


def test_probing_and_block_comparison_agree():
    rng = np.random.default_rng(3)
    fp = np.unique(rng.integers(0, 2**12, 9000, dtype=np.uint64) * np.uint64(2**30 + 1))
    big = np.unique(np.concatenate([fp, rng.integers(0, 2**63, 9000, dtype=np.uint64)]))
    assert len(big) > 8192
    a, b = S._forest(big, 2)
    parent = {int(x): int(x) for x in big}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        assert (x ^ y).bit_count() <= 2
        parent[find(x)] = find(y)
    for i in range(0, len(big), 97):
        near = big[np.bitwise_count(big ^ big[i]) <= 2]
        assert {find(int(x)) for x in near} == {find(int(big[i]))}


def test_keep_one_and_empty(edge_docs, no_docs):
    kept = S.keep_one(edge_docs)
    want = {r[0] for r in brute.near_components([(r.doc_id, r.text) for r in edge_docs.collect()]) if r[0] == r[2]}
    assert kept.columns == edge_docs.columns and {r.doc_id for r in kept.collect()} == want
    assert S.near_dedup(no_docs).count() == 0 and S.keep_one(no_docs).count() == 0


def test_keep_one_decides_per_row(spark):
    """Null ids and ids with several texts: each component keeps exactly one row."""
    long = " ".join(f"w{i}" for i in range(400))
    other, third, clean = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, long), (None, long), (None, other), (None, third), (None, third), (2, long), (2, clean), (5, "x y"), (5, "x y"), (None, " ")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(1, long), (None, other), (None, third), (2, clean), (5, "x y"), (None, " ")]
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(want, key=str)


def test_keep_one_of_null_ids_without_repeats(spark):
    """One near copy and one clean row with null ids; no row is repeated."""
    long, clean = " ".join(f"w{i}" for i in range(400)), " ".join(f"c{i}" for i in range(60))
    docs = spark.createDataFrame([(7, long), (None, long + " "), (None, clean), (8, long + "  "), (8, "free text here")], "doc_id long, text string")
    got = S.keep_one(docs).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted([(7, long), (None, clean), (8, "free text here")], key=str)
