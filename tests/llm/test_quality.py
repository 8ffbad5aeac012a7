import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelkit.llm import quality as Q
from panelkit.llm.queries import op9_quality_classifier
from panelkit.llm.textstats import NAMES, text_stats

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op9_quality_classifier(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.97


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(Q.fold(F.col("doc_id")) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = Q.fit(docs, labels), Q.fit(docs, turned)
    assert a.weights == pytest.approx(b.weights) and a.cut == pytest.approx(b.cut)


def test_edge_cases(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(3, 1), (9, 0), (9, 0), (None, 1), (4, None), (77, 1), (6, 1), (8, 0)], "doc_id long, quality int")
    got = Q.quality_scores(edge_docs, labels).collect()
    assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1          # null and '' score alike
    assert Q.keep_good(edge_docs, labels).columns == edge_docs.columns
    none = Q.quality_scores(edge_docs, labels.limit(0))
    assert {round(r.score, 9) for r in none.collect()} == {0.7} and none.filter("predicted = 0").count() == 0
    assert Q.quality_scores(no_docs, labels).count() == 0


@pytest.mark.parametrize("text", [None, "", " ", "a", "\n\n", "x" * 50_000, "!! $$ %%", "\U0001f600 ñ"])
def test_stats_are_finite(text):
    x = text_stats(text)
    assert len(x) == len(NAMES) and all(v == v and abs(v) < 1e6 for v in x)


def test_cut_covers_all_labels_and_scores_match_plain_python(spark):
    """The weights may come from a sample; share and quantile of the cut may not."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = Q.fit(docs, labels, max_labelled=120)
    w = np.array(model.weights) / np.array(model.scale)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    strength = {i: float((np.array(text_stats(t)) - np.array(model.mean)) @ w) for i, t in texts.items()}
    used = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in strength]
    assert len(used) > 120
    want = np.quantile([strength[r.doc_id] for r in used], np.mean([1 - r.quality for r in used]))
    assert model.cut == pytest.approx(want, abs=1e-9)
    for r in Q.quality_scores(docs, labels, max_labelled=120).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-(strength[r.doc_id] - want) - math.log(7 / 3))), abs=1e-9)
