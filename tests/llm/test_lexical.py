import math
import re
from collections import Counter

import numpy as np
import pytest

from panelkit.llm import lexical as L
from panelkit.llm.queries import op12_lexical_search

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    """Every score of every document, in plain Python; docs and items are (id, text)."""
    cut = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in cut]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for row, ((i, c), n) in enumerate(zip(cut, sizes)):
            s = 0
            for t in terms(text):
                if t in c:
                    m = 100 - 75 + (75 * n * n_docs) // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, row, i))
        out += [(item_id, r + 1, x[4], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_query_matches_duckdb(spark):
    import duckdb
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    got = rows_of(op12_lexical_search(spark, SF))
    assert got == sorted(con.execute(L.SQL).fetchall(), key=str) and len(got) > 100


def test_query_equals_brute_force_with_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(L, "BUCKET_ROWS", 16)
    monkeypatch.setattr(L, "SEED_ROWS", 20)
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(L.search(docs, items)) == want
    assert rows_of(L.search(docs, items, items_per_block=7)) == want


def test_edge_cases(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "one ONE two"), (2, None), (3, "Ä x"), (4, "absent"), (None, "one"), (6, "a! b? c"), (1, "three")],
                                  "item_id int, text string")
    docs = edge_docs.select("doc_id", "text", "size").repartition(1).sortWithinPartitions("doc_id").cache()
    given = [(r.doc_id, r.text) for r in docs.collect()]
    got, want = rows_of(L.search(docs, items)), brute(given, [(r.item_id, r.text) for r in items.collect()])
    assert got == want and {r[0] for r in got} == {1, 3, None, 6}
    assert rows_of(L.search(edge_docs, items)) == want                   # clashing columns, other row order
    assert L.search(no_docs, items).count() == 0
    assert L.search(edge_docs, items.limit(0)).count() == 0


def test_copies_and_ties_rank_by_id(spark):
    docs = spark.createDataFrame([(i, "common rare" if i % 3 else "common") for i in range(3000, 0, -1)], "doc_id long, text string").repartition(5)
    got = rows_of(L.search(docs, spark.createDataFrame([(7, "rare common")], "item_id int, text string")))
    assert sorted(r[2] for r in got) == [1, 2, 4, 5, 7, 8, 10, 11, 13, 14]


@pytest.mark.parametrize("seed", range(6))
def test_a_bucket_loses_no_document_over_its_threshold(seed):
    rng = np.random.default_rng(seed)
    for _ in range(40):
        n, p = int(rng.integers(1, 60)), int(rng.integers(2, 30))
        dense = np.where(rng.random((n, p)) < 0.3, rng.integers(1, 10 ** int(rng.integers(1, 10)), (n, p)), 0)
        dense[:, 0] += (dense.sum(axis=1) == 0)
        doc, terms_ = np.nonzero(dense)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
        norm = np.sqrt((dense.astype(float) ** 2).sum(axis=1))
        bucket = L.Bucket(norm, offsets, terms_, dense[doc, terms_], p)
        ids = np.sort(rng.choice(p, int(rng.integers(1, p)), replace=False))
        repeats = rng.integers(1, 4, len(ids))
        scores = dense[:, ids] @ repeats
        for threshold in {1, int(np.median(scores)) + 1, int(scores.max()) + 1, max(1, int(scores.max()))}:
            docs, found = bucket.survivors(ids, repeats, threshold)
            want = np.flatnonzero(scores >= threshold)
            assert sorted(docs.tolist()) == want.tolist() and dict(zip(docs.tolist(), found.tolist())) == {i: scores[i] for i in want}
