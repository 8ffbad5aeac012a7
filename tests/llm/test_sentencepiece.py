import itertools
import math

import pytest
import sentencepiece

import brute
from panelkit.llm import sentencepiece_trie as T
from panelkit.llm.queries import op1_sentencepiece

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=T.MODEL_PATH)


def test_query_matches_the_library(spark, small_rows, lib):
    text = {i: t for i, t, _ in small_rows}
    rows = op1_sentencepiece(spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r.token_ids == lib.encode(text[r.doc_id]) and r.round_trip
        assert r.decoded_sha256 == brute.sha(text[r.doc_id]) and r.n_tokens == len(r.token_ids)


def test_edge_cases(edge_docs, no_docs, lib):
    texts = sorted((r.text or "" for r in edge_docs.collect()))
    rows = T.encode_documents(edge_docs).collect()
    assert sorted(map(tuple, (r.token_ids for r in rows))) == sorted(tuple(lib.encode(t)) for t in texts)
    assert [r.doc_id for r in rows if not r.round_trip] == [12]               # it holds the mark itself
    assert T.encode_documents(no_docs).count() == 0
    back = {r.doc_id: r.text for r in T.decode_documents(T.encode_documents(edge_docs.filter("doc_id != 12"))).collect()}
    assert back == {r.doc_id: r.text or "" for r in edge_docs.filter("doc_id != 12").collect()}


def test_odd_texts_match_the_library(lib):
    e = T.Encoder.get(open(T.MODEL_PATH, "rb").read())
    odd = ["", " ", "   ", "a  b   c", "\x00\n\r\n\t", "日本語テキスト", "🎉👩‍👧 x", "if (x) {\r\n\treturn;\r\n}", "a" * 999, "0123456789" * 30,
           "ééé ççç", "▁▁x", " lead", "trail "]
    for t, ids in zip(odd, e.encode(odd)):
        assert ids.tolist() == lib.encode(t), t


def test_prefixes_are_computed_once():
    v = T.Vocabulary(["<unk>", "a", "b", "ab", "abc", "c"], [0.0, -1, -2, -3, -4, -5], True, None, 0)
    calls = []
    real = v.extend_merge
    v.extend_merge = lambda word, back, last: (calls.append(len(word) + 1 - len(back)), real(word, back, last))[1]
    T.encode_words(v, {"abcabc", "abcabb", "abc", "abcab"})
    assert sum(calls) == len("abcabc") + 1                                       # a trie of 7 nodes


def test_unigram_finds_the_best_segmentation():
    pieces = ["<unk>", "a", "b", "c", "ab", "bc", "abc", "ca", "bca", "cab", "aabb", "abcab", "▁", "▁a", "▁ab"]
    scores = [0.0, -2.1, -2.3, -2.9, -3.1, -4.05, -6.2, -4.4, -6.9, -6.1, -7.7, -9.3, -1.7, -2.8, -3.9]
    v = T.Vocabulary(pieces, scores, False, None, 0)
    for n in range(1, 7):
        words = ["".join(w) for w in itertools.product("abc", repeat=n)]
        got = T.encode_words(v, words)
        for w in words:
            best = -math.inf
            for cuts in itertools.product((0, 1), repeat=n - 1):
                parts, start = [], 0
                for i, c in enumerate([*cuts, 1], 1):
                    if c:
                        parts.append(w[start:i])
                        start = i
                if all(p in v.ids for p in parts):
                    best = max(best, sum(v.rank[p] for p in parts))
            assert sum(scores[i] for i in got[w]) == pytest.approx(best), w
            assert "".join(pieces[i] for i in got[w]) == w
