"""Classifiers trained on Spark: neural network (MLlib MLP), kernel SVM via
random Fourier features + LinearSVC, fold-based grid search and a shared-fold
leaderboard (ML18-ML21, ML25).

* MLP: ``MultilayerPerceptronClassifier([p, hidden, 2])``: two softmax
  outputs instead of one logistic unit, and no weight decay (MLlib has
  none); distributed L-BFGS.
* RBF SVM: exact kernel SVMs need the n x n kernel; here the RBF kernel
  exp(-gamma |x - x'|^2) is approximated by D random Fourier features
  (Rahimi & Recht 2007) computed as row expressions, then a linear SVM.
  Cost C maps to ``regParam = 1 / (C n)`` with standardisation off, so the
  penalty is on the weights of the kernel features themselves.
* ``fit_svm`` deals the rows so that no partition holds over ``FEATURE_BYTES`` of kernel features;
  MLlib keeps all of them for the fit, so beyond ``KEPT_BYTES`` the same machine is fitted on
  features made anew in every pass (``hinge``).
* Scoring keeps every row: one with a missing predictor has a NULL score.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import LinearSVC, LinearSVCModel, MultilayerPerceptronClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.models.batched import in_blocks
from panelkit.models.hinge import fit_linear_svm


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Rows with all of ``cols``, assembled (for fitting)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="skip").transform(df)


def scored_rows(model, df: DataFrame, cols: Sequence[str], pick: dict, expand=None) -> DataFrame:
    """``df`` with the columns of ``pick`` (name -> expression on the model's
    output); NULL where a predictor is missing or NaN.  ``expand`` maps the
    (filled) predictor names to feature expressions."""
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    # a stand-in for incomplete rows keeps them in the one pass
    inputs = [f"_f_{c}" for c in cols]
    filled = df.withColumn("_whole", whole).withColumns({
        f: F.when(F.col("_whole"), F.col(c).cast("double")).otherwise(F.lit(0.0)) for f, c in zip(inputs, cols)})
    if expand:
        made = expand(inputs)
        filled, inputs = filled.withColumns(made), list(made)
    out = model.transform(VectorAssembler(inputCols=inputs, outputCol="features").transform(filled))
    out = out.withColumns({name: F.when(F.col("_whole"), expr) for name, expr in pick.items()})
    return out.select(*df.columns, *pick)


def fit_mlp(train: DataFrame, features: Sequence[str], label: str, hidden: int = 3, max_iter: int = 100,
            seed: int = 42):
    d = assemble(train, features)
    mlp = MultilayerPerceptronClassifier(layers=[len(features), hidden, 2], maxIter=max_iter, seed=seed,
                                         featuresCol="features", labelCol=label, blockSize=128)
    return mlp.fit(d)


def score_mlp(model, df: DataFrame, features: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Probability of class 1 and the 0/1 prediction at ``threshold``."""
    s = scored_rows(model, df, features, {"prob": vector_to_array("probability")[1]})
    return s.withColumn("pred", (F.col("prob") >= threshold).cast("int"))


def fourier_weights(p: int, gamma: float, n_features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), size=(n_features, p))
    return w, rng.uniform(0.0, 2 * np.pi, size=n_features)


def fourier_columns(cols: Sequence[str], gamma: float, n_features: int, seed: int = 42) -> dict:
    """RBF kernel feature map: z_k = sqrt(2/D) cos(w_k . x + b_k), w ~ N(0, 2 gamma I)."""
    w, b = fourier_weights(len(cols), gamma, n_features, seed)
    amp = float(np.sqrt(2.0 / n_features))
    out = {}
    for k in range(n_features):
        lin = F.lit(float(b[k]))
        for j, c in enumerate(cols):
            lin = lin + F.lit(float(w[k, j])) * F.col(c)
        out[f"rff_{k}"] = F.lit(amp) * F.cos(lin)
    return out


def rff_frame(df: DataFrame, cols: Sequence[str], gamma: float, n_features: int, seed: int = 42) -> DataFrame:
    feats = fourier_columns(cols, gamma, n_features, seed)
    return assemble(df.withColumns(feats), list(feats))


#: kernel features that one partition of a fit holds, in bytes
FEATURE_BYTES = 100_000_000
#: kernel features that a fit keeps in all, in bytes
KEPT_BYTES = 1_000_000_000


def fit_svm(train: DataFrame, cols: Sequence[str], label: str, gamma: float, cost: float,
            n_features: int = 128, seed: int = 42, max_iter: int = 100, n_rows: int | None = None,
            tol: float = 1e-6):
    whole = finite_rows(train, cols)
    if whole.count() * n_features * 8 > KEPT_BYTES:
        return fit_svm_in_passes(whole, cols, label, gamma, cost, n_features, seed, max_iter, n_rows, tol)
    d = rff_frame(train, cols, gamma, n_features, seed)
    n = n_rows if n_rows is not None else d.count()
    # the features are kept for all steps and are several times as large as the rows: the
    # partitions are cut by their size, before they are made
    parts = -(-n * n_features * 8 // FEATURE_BYTES)
    if d.rdd.getNumPartitions() < parts:
        d = rff_frame(train.select(*cols, label).repartition(parts), cols, gamma, n_features, seed)
    svc = LinearSVC(featuresCol="features", labelCol=label, regParam=1.0 / (cost * n), maxIter=max_iter,
                    tol=tol, standardization=False)
    return svc.fit(d)


def finite_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The rows that ``assemble`` keeps of the kernel features of ``cols``."""
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.coalesce(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.lit(False))     # NaN is above all
    return df.where(whole)


def fit_svm_in_passes(train: DataFrame, cols: Sequence[str], label: str, gamma: float, cost: float, n_features: int, seed: int,
                      max_iter: int, n_rows: int | None, tol: float) -> LinearSVCModel:
    """The machine of ``fit_svm`` on finite rows without its features being kept: only ``cols`` and the label are."""
    names, kept = list(cols), F.col(label).cast("double")
    valid = F.when(kept.isin(0.0, 1.0), kept).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("double"))
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in names], valid.alias("_label"))
    w, b = fourier_weights(len(names), gamma, n_features, seed)
    amp = np.sqrt(2.0 / n_features)

    def make(x: np.ndarray) -> np.ndarray:
        z = x @ w.T
        z += b
        np.cos(z, out=z)
        z *= amp
        return z

    data = in_blocks(rows, rows.columns)
    try:
        coef, intercept, _ = fit_linear_svm(data, names, "_label", make, n_features, cost, n_rows, max_iter, tol)
    finally:
        data.unpersist()
    sc = train.sparkSession.sparkContext
    made = sc._jvm.org.apache.spark.ml.classification.LinearSVCModel(LinearSVC().uid, _py2java(sc, Vectors.dense(coef)), intercept)
    return LinearSVCModel(made)


def score_svm(model, df: DataFrame, cols: Sequence[str], gamma: float, n_features: int = 128,
              seed: int = 42) -> DataFrame:
    return scored_rows(model, df, cols, {"pred": F.col("prediction").cast("int")},
                       lambda inputs: fourier_columns(inputs, gamma, n_features, seed))


def svm_grid(train: DataFrame, cols: Sequence[str], label: str, fold_col: str, gammas: Sequence[float],
             costs: Sequence[float], n_features: int = 64, seed: int = 42, max_iter: int = 50,
             parallelism: int | None = None, tol: float = 1e-4) -> list[tuple[float, float, float]]:
    """Cross-validated error for every (gamma, cost) on fixed folds.

    The feature map depends on gamma, so gammas are an outer loop; costs are
    a ``CrossValidator`` grid on ``regParam`` with the given fold column.
    Returns (gamma, cost, cv_error).
    """
    n = train.count()
    k = train.select(fold_col).distinct().count()
    out = []
    for g in gammas:
        d = rff_frame(train, cols, g, n_features, seed).select("features", label, fold_col).cache()
        svc = LinearSVC(featuresCol="features", labelCol=label, maxIter=max_iter, tol=tol, standardization=False)
        # each CV fit trains on (k-1)/k of the rows
        regs = [1.0 / (c * n * (k - 1) / k) for c in costs]
        grid = ParamGridBuilder().addGrid(svc.regParam, regs).build()
        ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")
        cv = CrossValidator(estimator=svc, estimatorParamMaps=grid, evaluator=ev, foldCol=fold_col,
                            parallelism=parallelism or len(costs))
        m = cv.fit(d)
        for c, acc in zip(costs, m.avgMetrics):
            out.append((float(g), float(c), float(1.0 - acc)))
        d.unpersist()
    return out
