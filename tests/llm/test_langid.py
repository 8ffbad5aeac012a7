import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelkit.llm import langid as G
from panelkit.llm.queries import op11_language_id

SF = "/root/testdata/sf0.01"


def brute_tree(texts):
    """{context: {byte: n}} over byte tuples; 0 marks the start, bytes count from 1."""
    tree = defaultdict(Counter)
    for t in texts:
        x = [0] * G.ORDER + [b + 1 for b in t.encode()]
        for i in range(G.ORDER, len(x)):
            for k in range(G.ORDER + 1):
                tree[tuple(x[i - k:i]), k][x[i]] += 1
    return tree


def brute_bits(tree, text):
    total = 0
    x = [0] * G.ORDER + [b + 1 for b in text.encode()]
    for i in range(G.ORDER, len(x)):
        gone, bits = set(), 0.0
        for k in range(G.ORDER, -1, -1):
            held = {s: n for s, n in tree.get((tuple(x[i - k:i]), k), {}).items() if s not in gone}
            if not held:
                continue
            n, d = sum(held.values()), len(held)
            if x[i] in held:
                bits -= math.log2(held[x[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
            gone |= set(held)
        else:
            bits += math.log2(256 - len(gone))
        total += round(bits * G.SCALE)
    return total


def model_of(groups):
    trees = []
    for texts in groups.values():
        data, offsets = G._text_buffer(pa.array(texts))
        keys, counts = [], []
        all_grams = np.concatenate([g for _, g in G._slices(data, offsets)])
        for k in range(G.ORDER + 1):
            found, n = np.unique(all_grams % G.BASE ** (k + 1), return_counts=True)
            keys.append(found)
            counts.append(n)
        trees.append(G.Tree.of(keys, counts))
    return G.LanguageModel(list(groups), trees)


@pytest.mark.parametrize("slice_bytes", [7, 64, 2_000_000])
def test_code_lengths_equal_plain_python(slice_bytes, monkeypatch):
    monkeypatch.setattr(G, "SLICE_BYTES", slice_bytes)
    rng = random.Random(5)
    groups = {lang: ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(30)] + ["", "a"]
              for lang, alphabet in (("aa", "abc é"), ("bb", "abdß "))}
    asked = ["", "a", "abcab", "éé ß", "日本", "abd" * 50, "b ", "zzz" + "abc " * 20]
    got, sizes = G.code_lengths(model_of(groups), pa.array(asked))
    for i, texts in enumerate(groups.values()):
        tree = brute_tree(texts)
        want = [brute_bits(tree, t) for t in asked]
        assert np.abs(got[i] - want).max() <= 1 * len("".join(asked)) and got[i][0] == 0      # rounding ties only
    assert sizes.tolist() == [len(t.encode()) for t in asked]


def test_fit_counts_what_plain_python_counts(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("Le chat, noir 12", "fr"), ("the CAT sat", "en"), ("el gato", "es"), ("the dog", "en")] * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = G.fit(docs)
    for lang, tree in zip(model.langs, model.trees):
        texts = [r.body for r in docs.filter(~G.held_out(F.col("doc_id")) & (F.col("lang") == lang)).select(G.folded(F.col("text")).alias("body")).collect()]
        want = brute_tree(texts)
        for k, order in enumerate(tree.orders):
            assert sum(order.n) == sum(sum(c.values()) for (ctx, kk), c in want.items() if kk == k)
            assert len(order.contexts) == sum(kk == k for _, kk in want)
        bits = [brute_bits(want, t) for t in ("the dog", "chat")]
        got, _ = G.code_lengths(G.LanguageModel([lang], [tree]), pa.array(["the dog", "chat"]))
        assert np.abs(got[0] - bits).max() <= 8


def test_held_out_accuracy(spark):
    got = op11_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count() and {"doc_id", "held_out", "lang_pred", "score"} <= set(got.columns)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.lang_pred == r.lang for r in held) / len(held)
    assert right > 0.98, right


def test_held_out_labels_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    turned = docs.withColumn("lang", F.when(G.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = (sorted(tuple(r) for r in G.language_id(d).collect()) for d in (docs, turned.repartition(5)))
    assert a == b


def test_gram_limit_keeps_the_tables_bounded_and_nested(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = G.fit(docs, max_grams=4000)
    assert sum(len(o.keys) for t in model.trees for o in t.orders) <= 4000
    for t in model.trees:
        for k in range(1, G.ORDER + 1):
            assert set((t.orders[k].keys % G.BASE ** k).tolist()) <= set(t.orders[k - 1].keys.tolist())


def test_edge_cases(spark, edge_docs, no_docs):
    got = {(r.doc_id, r.lang_pred, r.score) for r in G.language_id(edge_docs).collect()}
    assert {p for i, p, s in got if i in (1, 2, 10)} == {"und"} and {s for i, p, s in got if i in (1, 2, 10)} == {0.0}
    assert {p for i, p, s in got if i in (3, 6, 8, 9, 11, 12)} == {"en"} and len(G.language_id(edge_docs).collect()) == edge_docs.count()
    digits = spark.createDataFrame([(1, "123 456", "en"), (2, "word", None), (3, "word", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in G.language_id(digits).collect()} == {"und"}              # nothing could be learned
    assert G.language_id(no_docs).count() == 0
