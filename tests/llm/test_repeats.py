import random
from collections import Counter

import numpy as np
import pytest

import brute
from panelkit.llm import repeats as R
from panelkit.llm import substring as S
from panelkit.llm import suffix_dedup as X
from panelkit.llm.anchors import byte_symbols, find_runs, word_symbols
from panelkit.llm.bwt import repeated_starts
from panelkit.llm.queries import op4_substring_dedup, op5_suffix_dedup

SF = "/root/testdata/sf0.001"


def words_want(rows, n):
    out = []
    for (i, _), (w, gone) in zip(rows, brute.windows_removed([t for _, t in rows], n)):
        out.append((i, len(w), sum(gone), brute.sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out, key=str)


def bytes_want(rows, n):
    import hashlib
    out = []
    for (i, _), (r, gone) in zip(rows, brute.bytes_removed([t for _, t in rows], n)):
        runs = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((i, len(r), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_word_query_matches_brute_force(spark, small_rows):
    rows = [(i, t) for i, t, _ in small_rows]
    assert rows_of(op4_substring_dedup(spark, SF)) == words_want(rows, 35)


def test_byte_query_matches_brute_force(spark, small_rows):
    rows = [(i, t) for i, t, _ in small_rows]
    assert rows_of(op5_suffix_dedup(spark, SF)) == bytes_want(rows, 400)


def messy_rows(seed):
    """Shared passages in different surroundings, near copies, periodic texts, nulls, repeated rows."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "🎉x"]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randrange(6, 25))) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "a " * 200), (3, "ab" * 300), (3, "ab" * 300), (None, passages[0])]
    for i in range(4, 60):
        parts = [rng.choice([rng.choice(passages), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 12)))]) for _ in range(rng.randrange(1, 6))]
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(parts)))
    return rows


@pytest.mark.parametrize("max_contexts", [1, 4096])
def test_words_on_messy_texts(spark, max_contexts):
    rows = messy_rows(1)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, g int, body string")
    got = S.substring_dedup(df, window=7, gram=3, max_contexts=max_contexts).drop("kept")
    assert rows_of(got) == words_want(rows, 7)


@pytest.mark.parametrize("max_contexts, at_once", [(1, 2_000_000), (2048, 2_000_000), (2048, 1)])
def test_bytes_on_messy_texts(spark, monkeypatch, max_contexts, at_once):
    monkeypatch.setattr(R, "COMPARE_BYTES", at_once)
    rows = messy_rows(2)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, g int, body string")
    got = X.suffix_dedup(df, least=24, gram=8, max_contexts=max_contexts).drop("kept")
    assert rows_of(got) == bytes_want(rows, 24)


def test_sketch_joined_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(S, "BROADCAST_LIMIT_BYTES", 0)
    rows = messy_rows(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(S.substring_dedup(df, window=7, gram=3).drop("kept")) == words_want(rows, 7)


def test_edge_cases(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert rows_of(S.substring_dedup(edge_docs).drop("kept")) == words_want(rows, 35)
    assert rows_of(X.suffix_dedup(edge_docs).drop("kept")) == bytes_want(rows, 400)
    assert S.substring_dedup(no_docs).count() == 0 and X.suffix_dedup(no_docs).count() == 0


def test_equal_windows_share_their_anchor():
    rng = random.Random(4)
    raws = [" ".join(rng.choices("abcde", k=300)).encode() for _ in range(5)]
    for symbols, n in ((word_symbols(raws), 9), (byte_symbols(raws), 14)):
        runs = find_runs(symbols, n, 4)
        seen = {}
        covered = 0
        for start, count, g in zip(runs.start, runs.count, runs.gram):
            for s in range(start, start + count):
                seen.setdefault(symbols.x[s:s + n].tobytes(), set()).add(g)
                covered += 1
        assert all(len(g) == 1 for g in seen.values())
        assert covered == sum(max(0, b - a - n + 1) for a, b in zip(symbols.bounds, symbols.bounds[1:]))


def test_sketch_never_underestimates():
    grams = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    for row in range(S.ROWS):
        cell = S.cells(grams, 12, row)
        held = Counter(cell.tolist())
        assert cell.max() < 4096 and all(held[c] >= 1 for c in cell.tolist())


def test_interval_expansion_matches_brute_force():
    rng = random.Random(0)
    for trial in range(60):
        alphabet = b"ab" if trial % 3 else b"abcdefgh\x00\xff"
        base = bytes(rng.choice(alphabet) for _ in range(60))
        texts = [b"".join(rng.choice([base[rng.randrange(30):rng.randrange(30, 60)], bytes(rng.choice(alphabet) for _ in range(rng.randrange(12)))])
                          for _ in range(rng.randrange(4))) for _ in range(rng.randrange(1, 8))]
        for n in (1, 5, 12):
            held = Counter(t[i:i + n] for t in texts for i in range(len(t) - n + 1))
            assert [x.tolist() for x in repeated_starts(texts, n)] == [[held[t[i:i + n]] > 1 for i in range(len(t) - n + 1)] for t in texts]
