"""Quality scores learnt from preference pairs (Bradley-Terry).

A document's strength is w . x over the shape statistics of its text
(``textstats.py``); the chance that document a is preferred to b is
sigmoid(w . (x_a - x_b)). Pairs of a good and a bad labelled document train w
by logistic loss on feature differences (MLlib, no intercept). The cut is a
quantile of the strengths of all usable labelled documents: their share of bad
labels. The score is sigmoid(strength - cut + logit(0.7)), so 0.7 is the cut.

The weights are fitted on at most ``max_labelled`` labelled documents, those of
smallest id hash (a documented bound on the training sample only); the cut's
share and quantile cover all of them, and scoring covers every whole text in
one pass, without a shuffle.

Defined results: null and empty texts get the score of all-zero statistics;
labels that are null, or whose ids have no document, are ignored; of several
labels of one id the largest counts. With no labels, or labels of one class
only, w is 0 and every score is 0.7 (all kept). Empty tables give empty
results. Extra columns are ignored, or returned untouched by ``keep_good``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.llm.common import maybe_broadcast, written
from panelkit.llm.textstats import NAMES, text_stats
from panelkit.operators.quantile import quantiles_long

MAX_LABELLED = 20_000
PAIRS_PER_BAD = 8
CUT_SCORE = 0.7
REG = 1e-3


@dataclass(frozen=True)
class QualityModel:
    mean: list[float]
    scale: list[float]
    weights: list[float]
    cut: float


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids: 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4, F.lit(0))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def stats_of(text: pd.Series) -> pd.Series:
    return text.map(text_stats, na_action=None)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        max_labelled: int = MAX_LABELLED, pairs_per_bad: int = PAIRS_PER_BAD) -> QualityModel:
    """Learn from labelled rows outside the held-out fold."""
    usable = (labels.select(F.col("doc_id").alias("lid"), F.col("quality").cast("int").alias("q"))
              .filter("lid is not null and q in (0, 1)").filter(fold(F.col("lid")) != 2)
              .groupBy("lid").agg(F.max("q").alias("q")))
    chosen = usable.orderBy(F.xxhash64("lid"), "lid").limit(max_labelled)
    texts = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("body"))
    labelled = written(texts.join(maybe_broadcast(usable, 40), "lid").select("lid", "q", stats_of("body").alias("x")), "quality_labelled")
    sample = written(labelled.join(F.broadcast(chosen.select("lid")), "lid"), "quality_sample")
    p = len(NAMES)
    moments = sample.agg(*[F.avg(F.col("x")[i]) for i in range(p)], *[F.stddev_pop(F.col("x")[i]) for i in range(p)],
                         F.avg(1 - F.col("q"))).first()
    if moments[-1] is None or not 0 < moments[-1] < 1:
        return QualityModel([0.0] * p, [1.0] * p, [0.0] * p, 0.0)
    mean, scale = list(moments[:p]), [s if s and s > 1e-9 else 1.0 for s in moments[p:2 * p]]
    weights = _fit_pairs(_pairs(sample, mean, scale, pairs_per_bad))
    strength = sum(((F.col("x")[i] - mean[i]) * (weights[i] / scale[i]) for i in range(p)), F.lit(0.0))
    bad = labelled.agg(F.avg(1 - F.col("q"))).first()[0]
    cut = quantiles_long(labelled.select(strength.alias("strength")), "strength", [float(bad)]).first()["quantile"]
    return QualityModel(mean, scale, weights, float(cut))


def _pairs(sample: DataFrame, mean: list[float], scale: list[float], per_bad: int) -> DataFrame:
    """(good, bad) pairs as signed feature differences; every second one is turned round."""
    z = F.transform(F.arrays_zip("x", F.array(*map(F.lit, mean)).alias("m"), F.array(*map(F.lit, scale)).alias("s")),
                    lambda c: (c["x"] - c["m"]) / c["s"])
    std = sample.select("lid", "q", z.alias("z"))
    # the sample is bounded, so one ordered numbering of it is too
    good = std.filter("q = 1").select(F.col("z").alias("zg"), (F.row_number().over(Window.orderBy(F.xxhash64("lid"), "lid")) - 1).alias("g"))
    n_good = sample.filter("q = 1").count()
    bad = std.filter("q = 0").select(F.col("z").alias("zb"), "lid", F.explode(F.sequence(F.lit(1), F.lit(per_bad))).alias("k"))
    bad = bad.withColumn("g", F.pmod(F.xxhash64("lid", "k"), F.lit(n_good)).cast("int"))
    sign = F.when(F.col("k") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return bad.join(good, "g").select(
        F.zip_with("zg", "zb", lambda a, b: (a - b) * sign).alias("d"), (sign > 0).cast("double").alias("label"))


def _fit_pairs(pairs: DataFrame) -> list[float]:
    data = pairs.select(array_to_vector("d").alias("features"), "label").repartition(8).persist()
    try:
        lr = LogisticRegression(fitIntercept=False, standardization=False, regParam=REG, maxIter=100)
        return [float(x) for x in lr.fit(data).coefficients]
    finally:
        data.unpersist()


def score_column(model: QualityModel, text: str | Column) -> Column:
    """Score in (0, 1) of a whole text."""
    w = np.array(model.weights) / np.array(model.scale)
    shift = float(w @ np.array(model.mean)) + model.cut - math.log(CUT_SCORE / (1 - CUT_SCORE))

    @F.pandas_udf(T.DoubleType())
    def score(body: pd.Series) -> pd.Series:
        # plain sums over a fixed order: the same text scores the same in any batch
        s = [math.fsum(a * b for a, b in zip(w, text_stats(t))) - shift for t in body]
        return pd.Series([1 / (1 + math.exp(-x)) if x > -700 else 0.0 for x in s], dtype="float64")

    return score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = fit(docs, labels, id_col, text_col, max_labelled)
    scored = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 2).alias("held_out"),
                         score_column(model, F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT_SCORE).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``CUT_SCORE``, unchanged."""
    model = fit(docs, labels, id_col, text_col)
    names = docs.columns
    return docs.withColumn("_score", score_column(model, F.col(text_col))).filter(F.col("_score") >= CUT_SCORE).select(*names)
