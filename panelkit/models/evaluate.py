"""Model evaluation on Spark: tie-safe ROC/AUC, classification and regression
metrics, score distributions (WN3, WN4, ML22-ML24).

ROC points are computed per *distinct score* (ties collapse to one point),
so the curve and its trapezoid area do not depend on row order; the running
sums run over the distinct-score table in range blocks.  Rows without a score
or a label are not ranked; ``unscored`` counts them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.operators.prefix import running_sums, with_range_blocks
from panelkit.operators.quantile import quantiles_wide


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """``(threshold, tp, fp, tpr, fpr)`` per distinct score, descending score."""
    per = scored(df, label, score).groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("long")).alias("_pos"),
        F.sum((1 - F.col(label)).cast("long")).alias("_neg"))
    # distinct scores can grow with the data: the score table is written once,
    # already in blocks along the order
    order = [F.col("threshold").desc()]
    from panelkit.sources.io import checkpoint_table
    per = with_range_blocks(checkpoint_table(per, "roc_scores"), order, "_rblk")
    cum = running_sums(per, order, {"tp": F.col("_pos"), "fp": F.col("_neg")}, F.col("_rblk"), totals={"tp": "_P", "fp": "_N"})
    return cum.select("threshold", "tp", "fp", F.try_divide(F.col("tp"), F.col("_P")).alias("tpr"),
                      F.try_divide(F.col("fp"), F.col("_N")).alias("fpr"), "_pos", "_neg")


def scored(df: DataFrame, label: str, score: str) -> DataFrame:
    return df.where(F.col(label).isNotNull() & F.col(score).isNotNull())


def unscored(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row: how many rows have no score or no label, of how many."""
    return df.agg(F.count_if(F.col(label).isNull() | F.col(score).isNull()).alias("n_unscored"), F.count(F.lit(1)).alias("n"))


def auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Trapezoid area under the tie-collapsed ROC curve (one row).

    Equals sum over distinct scores of neg(s) * (tp_before(s) + pos(s)/2) / (P*N),
    i.e. the Mann-Whitney statistic with ties counted one half.
    """
    pts = roc_points(df, label, score)
    return pts.agg(
        F.try_divide(F.sum(F.col("_neg") * (F.col("tp") - F.col("_pos") / 2.0)),
                     F.sum("_pos") * F.sum("_neg")).alias("auc"),
        F.sum("_pos").alias("n_pos"), F.sum("_neg").alias("n_neg"))


def confusion_counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    return df.agg(
        F.count_if((F.col(pred) == 1) & (F.col(label) == 1)).alias("tp"),
        F.count_if((F.col(pred) == 0) & (F.col(label) == 0)).alias("tn"),
        F.count_if((F.col(pred) == 1) & (F.col(label) == 0)).alias("fp"),
        F.count_if((F.col(pred) == 0) & (F.col(label) == 1)).alias("fn"))


def class_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Accuracy, sensitivity, specificity, precision, F1, kappa, prevalence,
    predictive values and balanced accuracy from one counting pass."""
    c = confusion_counts(df, label, pred)
    tp, tn, fp, fn = (F.col(x).cast("double") for x in ("tp", "tn", "fp", "fn"))
    n = tp + tn + fp + fn
    acc = (tp + tn) / n
    sens = F.try_divide(tp, tp + fn)
    spec = F.try_divide(tn, tn + fp)
    prec = F.try_divide(tp, tp + fp)
    npv = F.try_divide(tn, tn + fn)
    pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return c.select(
        "tp", "tn", "fp", "fn", acc.alias("accuracy"), sens.alias("sensitivity"),
        spec.alias("specificity"), prec.alias("precision"),
        F.try_divide(2 * prec * sens, prec + sens).alias("f1"),
        F.try_divide(acc - pe, 1 - pe).alias("kappa"), ((tp + fn) / n).alias("prevalence"),
        npv.alias("npv"), ((sens + spec) / 2).alias("balanced_accuracy"))


def reg_metrics(df: DataFrame, y: str, yhat: str, back_transform: bool = False) -> DataFrame:
    """RMSE, MAE, R^2 (1 - SSE/SST) over rows with both values; with
    ``back_transform`` also RMSE/MAE on exp scale and MAE as % of the median
    of exp(y)."""
    df = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
    err = F.col(y) - F.col(yhat)
    base = df.agg(F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
                  F.sum(err * err).alias("_sse"), F.var_pop(y).alias("_vy"),
                  F.count(F.lit(1)).alias("n"),
                  *([F.sqrt(F.avg(F.pow(F.exp(y) - F.exp(yhat), 2))).alias("rmse_orig"),
                     F.avg(F.abs(F.exp(y) - F.exp(yhat))).alias("mae_orig")] if back_transform else []))
    out = base.withColumn("r2", 1 - F.try_divide(F.col("_sse"), F.col("_vy") * F.col("n"))).drop("_sse", "_vy")
    if back_transform:
        med = quantiles_wide(df.select(F.exp(y).alias("_ey")), "_ey", [0.5], [], ["_med"])
        out = out.crossJoin(F.broadcast(med)).withColumn(
            "mae_pct_of_median", F.col("mae_orig") * 100 / F.col("_med")).drop("_med")
    return out


def score_quartiles(df: DataFrame, label: str, score: str) -> DataFrame:
    return quantiles_wide(df, score, [0.0, 0.25, 0.5, 0.75, 1.0], [label],
                          ["min", "q1", "median", "q3", "max"])


__all__ = ["roc_points", "auc", "unscored", "class_metrics", "reg_metrics", "score_quartiles"]
