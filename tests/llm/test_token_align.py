import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from panelkit.llm import token_align as A
from panelkit.llm.queries import op13_token_alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    """The whole result in plain Python, with the files' own libraries."""
    hf = Tokenizer.from_file(A.A_PATH)
    hf.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=A.B_PATH)
    byte_of = A.byte_level_alphabet()

    def raw_b(k):
        return bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()

    docs, holders = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            e = hf.encode(" " + text, add_special_tokens=False)
            a = [(k, bytes(byte_of[c] for c in hf.id_to_token(k))) for k in e.ids]
            b = [(k, raw_b(k)) for k in sp.encode(text)]
            want = (" " + text).encode()
            if b"".join(r for _, r in a) == want == b"".join(r for _, r in b):
                ends_b, at, i = set(), 0, 0
                for _, r in b:
                    at += len(r)
                    ends_b.add(at)
                at, ends = 0, set()
                for _, r in a:
                    at += len(r)
                    if at in ends_b:
                        ends.add(at)
                sides = []
                for toks in (a, b):
                    at, cur, out = 0, [], []
                    for k, r in toks:
                        at += len(r)
                        cur.append(k)
                        if at in ends:
                            out.append(cur)
                            cur = []
                    sides.append(out)
                groups = list(zip(*sides))
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        holders.update(set(links))
        docs.append((doc_id, groups, links))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, groups, links in docs:
        s = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
                    sum(n for (x, y), n in links.items() if holders[x, y] == best[x]), sum(n * holders[p] for p, n in links.items()),
                    hashlib.sha256(s.encode()).hexdigest() if s else ""))
    return sorted(out, key=str)


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_query_equals_brute_force(spark, small_rows):
    assert rows_of(op13_token_alignment(spark, "/root/testdata/sf0.001")) == brute([(i, t) for i, t, _ in small_rows])


def test_edge_cases(spark, edge_docs, no_docs, monkeypatch):
    extra = [(20, "<|endoftext|> <s> </s> <unk>"), (21, "  two  spaces \n\n\t tab"), (22, "日本語のテキスト 漢字 🎉🎉 é"), (23, "\x00\x01 null byte"),
             (24, "aaaa" * 3000), (25, " "), (26, "­zero​width")]
    docs = edge_docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows)
    assert rows_of(A.alignment_links(docs)) == want
    assert all(r[1:] == (0, 0, 0, 0, 0, 0, "") for r in want if r[0] in (1, 2, 12))      # null, empty, holds U+2581
    assert A.alignment_links(no_docs).count() == 0
    assert set(A.align_documents(edge_docs).columns) == {"doc_id", "a_ids", "b_ids", "a_last", "b_last"}
    got = A.align_documents(docs).collect()
    assert all(len(r.a_ids) == len(r.a_last) and sum(r.a_last) == sum(r.b_last) for r in got)


def test_no_row_between_steps_holds_more_than_a_document(spark, monkeypatch):
    rows = [(k % 30, f"passage {k % 7} on rivers, weirs and 日本 locks no {k}") for k in range(60)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    made, write = [], A.written
    monkeypatch.setattr(A, "written", lambda *a, **k: made.append(write(*a, **k)) or made[-1])
    assert rows_of(A.alignment_links(docs)) == brute(rows)
    links = made[0].collect()
    assert len(links) == len(rows)
    pairs = [(r.bundle, p) for r in links for p in r.pairs]
    assert len(set(pairs)) == len(pairs)               # a bundle names a pair once


def test_wide_groups_are_linked_by_distinct_ids(monkeypatch):
    with open(A.A_PATH, "rb") as f, open(A.B_PATH, "rb") as g:
        made = A.Aligner(f.read(), g.read())
    texts = ["plain words and zzzqqq 日本 éàü", "", None, "x" * 999, "tail"]
    x = made.bundle(texts)
    want = [v.tolist() for v in x.links()]
    monkeypatch.setattr(A, "WIDE_GROUP", 1)
    assert [v.tolist() for v in x.links()] == want


@pytest.mark.parametrize("seed", range(8))
def test_run_skipping_finds_every_common_end(seed):
    rng = random.Random(seed)
    for _ in range(200):
        total = rng.randint(1, 300)
        share = rng.choice([0.05, 0.5, 0.95])
        a = np.array(sorted({i for i in range(1, total) if rng.random() < share} | {total}))
        b = np.array(sorted({i for i in range(1, total) if (i in a) == (rng.random() < 0.9)} | {total}))
        last_a, last_b = np.ones(len(a), dtype=bool), np.ones(len(b), dtype=bool)
        found = np.array(A.irregular_groups(a, b), dtype=np.int64).reshape(-1, 4)
        A._inside(last_a, found[:, 0], found[:, 1])
        A._inside(last_b, found[:, 2], found[:, 3])
        assert a[last_a].tolist() == b[last_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_both_libraries_cut_words_alike():
    with open(A.A_PATH, "rb") as f:
        fast = A.ByteLevel(f.read())
    assert fast.fast is not None
    slow = Tokenizer.from_file(A.A_PATH)
    slow.encode_special_tokens = True
    rng = random.Random(3)
    ranges = [(32, 127), (0, 33), (0x80, 0x250), (0x250, 0x3000), (0x3000, 0xD800), (0xE000, 0x10000), (0x10000, 0x20000)]
    for _ in range(3000):
        text = "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randint(1, 12)))
        assert fast.encode([text])[0] == slow.encode(text, add_special_tokens=False).ids, repr(text)
