"""Registered queries without a SQL oracle: additive model, neural network,
kernel SVM, grid search, leaderboard and observed-vs-fitted extracts
(ML14-ML21, ML25, CH6).  Checked by row counts here and by property tests
in ``tests/``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from panelkit.models import batched, classify as C, evaluate as EV, folds, gam, glm, irls, kernel_svm as KS, logistic_net as LN, ols
from panelkit.operators import features as FE, reshape, sampling as SP
from panelkit.operators.quantile import quantiles_long
from panelkit.plans.registry import register
from panelkit.sources import tables as T

SVM_FEATURES = 64
GAM_SMOOTHS = ["l_quantity", "l_discount", "l_tax"]
NUMERIC = ["log_price", "l_discount", "l_tax"]


def class_frame(spark, d):
    """L classification frame: label = quantity > 25; standardised numeric
    predictors (train statistics) and treatment dummies; 80/20 hash split."""
    li = T.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).cast("int").alias("label"),
        F.ln("l_extendedprice").alias("log_price"), "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    levels = FE.factors_levels(li, ["l_returnflag", "l_linestatus"])
    li, d1 = FE.dummy_columns(li, "l_returnflag", levels["l_returnflag"])
    li, d2 = FE.dummy_columns(li, "l_linestatus", levels["l_linestatus"])
    li = SP.split_hash(li, ["l_orderkey", "l_linenumber"], 0.8, seed=42)
    li = FE.standardise(li, NUMERIC, FE.train_stats(li, NUMERIC, "is_train"), suffix="_z")
    feats = [f"{c}_z" for c in NUMERIC] + d1 + d2
    return li, feats


def gam_frame(spark, d):
    li = T.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.ln("l_extendedprice").alias("y"), "l_quantity", "l_discount", "l_tax",
        "l_returnflag")
    li, dn = FE.dummy_columns(li, "l_returnflag", FE.factor_levels(li, "l_returnflag"))
    li = SP.split_hash(li, ["l_orderkey", "l_linenumber"], 0.8, seed=42)
    return li, dn


def _fit_gam(spark, d):
    li, par = gam_frame(spark, d)
    fit = gam.fit_gam(li.where(F.col("is_train") == 1), "y", GAM_SMOOTHS, par, k=10)
    return li, fit


@register("gam_terms")
def gam_terms(spark, d):
    _li, fit = _fit_gam(spark, d)
    rows = [("smooth", c, fit.edf[c], float(fit.lambdas[c]), None, None, None) for c in fit.smooths]
    rows += [("parametric", t, None, None, b, se, pct) for t, b, se, pct in fit.parametric_rows()]
    return spark.createDataFrame(
        rows, "kind string, term string, edf double, lambda double, estimate double, std_error double, "
              "pct_change double")


@register("gam_score", """
WITH c AS (SELECT count(*) AS n, avg(ln(l_extendedprice)) AS mean_y FROM lineitem),
t AS (SELECT unnest(['(Intercept)', 'l_returnflag_N', 'l_returnflag_R']) AS term
      UNION ALL
      SELECT 's_' || s.name || '_' || j.j FROM (VALUES ('l_quantity'), ('l_discount'), ('l_tax')) s(name), range(1, 10) j(j))
SELECT term, CAST(0 AS DOUBLE) AS mean_score, n, round(mean_y, 8) AS mean_fitted FROM c, t
""")
def gam_score(spark, d):
    """The penalised score equations of the additive fit: for every term the
    mean of residual times column less the penalty's slope is 0 (ML14)."""
    li, par = gam_frame(spark, d)
    fit = gam.fit_gam(li, "y", GAM_SMOOTHS, par, k=10)
    pull = {"(Intercept)": 0.0, **fit.penalty_slope()}
    n_fitted, fitted, n_left, sums = gam.score_sums(li, fit, "y")
    rows = [(t, float(s / n_left - v / fit.n), float(fitted / n_fitted)) for (t, v), s in zip(pull.items(), sums)]
    scores = spark.createDataFrame(rows, "term string, score double, fitted double")
    return scores.crossJoin(F.broadcast(li.agg(F.count(F.lit(1)).alias("n")))).select(
        "term", F.abs(F.round("score", 6)).alias("mean_score"), "n", F.round("fitted", 8).alias("mean_fitted"))


@register("gam_grid")
def gam_grid(spark, d):
    """Smooth effect of quantity on a 200-point grid crossed with the
    return-flag levels (treatment dummies set per level), the other smooths at
    their training medians; SE band and back-transformed band."""
    li, fit = _fit_gam(spark, d)
    levels = FE.factor_levels(li, "l_returnflag")
    dummies = [FE.level_name("l_returnflag", lv) for lv in levels[1:]]
    mapping = {lv: {dn: float(dn == FE.level_name("l_returnflag", lv)) for dn in dummies} for lv in levels}
    others = [c for c in GAM_SMOOTHS if c != "l_quantity"]
    long = reshape.unpivot(li.where(F.col("is_train") == 1), [], others, "variable", "value")
    medians = {r["variable"]: r["quantile"] for r in quantiles_long(long, "value", [0.5], ["variable"]).collect()}
    return gam.effect_grid(spark, fit, "l_quantity", n=200, fixed=medians, factor=("l_returnflag", mapping))


@register("gam_eval")
def gam_eval(spark, d):
    li, fit = _fit_gam(spark, d)
    test = li.where(F.col("is_train") == 0).withColumn("yhat", fit.fitted())
    return EV.reg_metrics(test, "y", "yhat", back_transform=True)


def _mlp_scored(spark, d, max_iter=300):
    li, feats = class_frame(spark, d)
    m = C.fit_mlp(li.where(F.col("is_train") == 1), feats, "label", hidden=3, max_iter=max_iter)
    return C.score_mlp(m, li.where(F.col("is_train") == 0), feats)


@register("nn_metrics")
def nn_metrics(spark, d):
    s = _mlp_scored(spark, d)
    return EV.class_metrics(s, "label", "pred").withColumn("model", F.lit("mlp p-3-2"))


@register("nn_confusion")
def nn_confusion(spark, d):
    from panelkit.operators.aggregate import contingency
    s = _mlp_scored(spark, d)
    return contingency(s.select(F.col("pred").alias("Predicted"), F.col("label").alias("Actual")),
                       "Predicted", "Actual", [0, 1], [0, 1]).withColumnRenamed("n", "Freq")


@register("nn_decay_metrics")
def nn_decay_metrics(spark, d):
    """p-3-1 logistic network with weight decay 0.001 (entropy loss, BFGS on
    the driver, gradients as Spark jobs); held-out metrics at the 0.5 cut."""
    li, feats = class_frame(spark, d)
    net = LN.fit_logistic_net(li.where(F.col("is_train") == 1), feats, "label", hidden=3, decay=0.001,
                              max_iter=300)
    s = LN.score(net, li.where(F.col("is_train") == 0))
    return EV.class_metrics(s, "label", "pred").withColumns(
        {"model": F.lit("logistic net p-3-1, decay 0.001"), "iterations": F.lit(net.iterations)})


@register("svm_metrics")
def svm_metrics(spark, d):
    li, feats = class_frame(spark, d)
    train = li.where(F.col("is_train") == 1)
    m = C.fit_svm(train, feats, "label", gamma=0.1, cost=1.0, n_features=SVM_FEATURES, max_iter=100, tol=1e-4)
    s = C.score_svm(m, li.where(F.col("is_train") == 0), feats, gamma=0.1, n_features=64)
    return EV.class_metrics(s, "label", "pred").withColumn("model", F.lit("rbf-rff svm"))


#: the grid of the reference: costs, and kernel widths that include 1 / 7 predictors
SVM_COSTS = [1.0, 10.0, 100.0]
SVM_GAMMAS = [0.01, 0.1, 0.1429]


def _svm_search(spark, d):
    li, feats = class_frame(spark, d)
    train = SP.kfold(li.where(F.col("is_train") == 1), ["l_orderkey", "l_linenumber"], 5, seed=7)
    return li, KS.grid_search(train, feats, "label", "fold", SVM_GAMMAS, SVM_COSTS)


@register("svm_grid")
def svm_grid(spark, d):
    """Cross-validated error of every (cost, gamma) on five folds; the best
    setting, refitted on all training rows, on the held-out rows."""
    li, found = _svm_search(spark, d)
    t = spark.createDataFrame(found.rows, "gamma double, cost double, cv_error double, n_cv long")
    test_acc = EV.class_metrics(found.best.score(li.where(F.col("is_train") == 0)), "label", "pred").select("accuracy")
    is_best = (F.col("gamma") == found.best.gamma) & (F.col("cost") == found.best.cost)
    return (t.crossJoin(F.broadcast(test_acc))
            .select("gamma", "cost", "cv_error", "n_cv", is_best.cast("int").alias("best"),
                    F.when(is_best, F.col("accuracy")).alias("test_accuracy_refit")))


@register("svm_confusion")
def svm_confusion(spark, d):
    """Confusion counts of the tuned machine on the held-out rows."""
    from panelkit.operators.aggregate import contingency
    li, found = _svm_search(spark, d)
    s = found.best.score(li.where(F.col("is_train") == 0))
    return contingency(s.select(F.col("pred").alias("Predicted"), F.col("label").alias("Actual")),
                       "Predicted", "Actual", [0, 1], [0, 1]).withColumnRenamed("n", "Freq")


_FOLD = """CAST(CAST(('0x' || substr(md5(concat_ws('#', l_orderkey::VARCHAR, l_linenumber::VARCHAR, '{seed}')), 1, 8)) AS BIGINT) {op} AS {kind})"""


@register("svm_grid_folds", f"""
WITH d AS (SELECT {_FOLD.format(seed=42, op='< ' + str(int(0.8 * 2 ** 32)), kind='INTEGER')} AS is_train,
                  {_FOLD.format(seed=7, op='% 5', kind='INTEGER')} AS fold FROM lineitem),
f AS (SELECT fold, count(*) AS n_held_out, (SELECT count(*) FROM d WHERE is_train = 1) - count(*) AS n_train
      FROM d WHERE is_train = 1 GROUP BY fold)
SELECT gamma::DOUBLE AS gamma, cost::DOUBLE AS cost, fold, n_train, n_held_out
FROM f, (VALUES (0.01), (0.1), (0.1429)) g(gamma), (VALUES (1), (10), (100)) c(cost)
""")
def svm_grid_folds(spark, d):
    """The settings of the grid search with the rows each trains and is judged on."""
    li, _ = class_frame(spark, d)
    train = SP.kfold(li.where(F.col("is_train") == 1), ["l_orderkey", "l_linenumber"], 5, seed=7)
    sizes = train.groupBy("fold").agg(F.count(F.lit(1)).alias("n_held_out"))
    total = sizes.agg(F.sum("n_held_out").alias("n"))
    settings = spark.createDataFrame([(g, c) for g in SVM_GAMMAS for c in SVM_COSTS], "gamma double, cost double")
    return (sizes.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(settings))
            .select("gamma", "cost", "fold", (F.col("n") - F.col("n_held_out")).alias("n_train"), "n_held_out"))


FOLDS = 5


@register("leaderboard")
def leaderboard(spark, d):
    """Five models on the same five folds: mean held-out accuracy of the 0/1
    label. One scan gives the cross-products of every training set for the linear
    and the additive model; the iterative models train all folds in the same passes."""
    li, feats = class_frame(spark, d)
    li = SP.kfold(li, ["l_orderkey", "l_linenumber"], FOLDS, seed=7)
    smooth_cols = [f"{c}_z" for c in NUMERIC]
    dummies = [c for c in feats if c not in smooth_cols]
    rows = li.select(*[F.col(c).cast("double") for c in feats], F.col("label").cast("double"), F.col("fold").cast("double")).dropna()
    smooths = gam.smooth_terms(rows, smooth_cols, k=10)
    data = batched.in_blocks(rows, rows.columns, by="fold")
    try:
        basis = [n for s in smooths.values() for n in s[4]]
        at, make = [feats.index(c) for c in smooth_cols], gam.design_matrix(smooths)
        design = folds.Design(feats, [*feats, *basis], lambda b: np.hstack([b, make(b[:, at])]))
        wide = design.names
        grams = folds.training_grams(data, design, "label", "fold", FOLDS)
        mean, scale = folds.block_moments(data, feats)
        lm = np.zeros((FOLDS, 1 + len(wide)))
        additive, logit = lm.copy(), lm.copy()
        for k, g in enumerate(grams):
            _place(lm[k], wide, ols.ols_from_gram(folds.sub_gram(g, feats)))
            fit = gam.gam_from_gram(folds.sub_gram(g, [*dummies, *basis]), smooths, dummies)
            additive[k, 0] = fit.intercept
            for n, b in zip(fit.names, fit.coef):
                additive[k, 1 + wide.index(n)] = b
        for k, fit in enumerate(irls.newton(data, "label", feats, "binomial", mean, scale, fold="fold", leave_out=range(FOLDS))):
            logit[k, 0] = fit.coef[0]
            logit[k, 1:1 + len(feats)] = fit.coef[1:]
        errors = folds.held_out_errors(data, design, "label", "fold", FOLDS, {"lm": (lm, 0.5), "gam": (additive, 0.5), "logit": (logit, 0.0)})
        nets = LN.fit_fold_nets(data, feats, "label", "fold", FOLDS, hidden=3, decay=0.001, max_iter=300)
        errors["net"] = LN.held_out_net_errors(data, feats, "label", "fold", 3, [r.theta for r in nets])
    finally:
        data.unpersist()
    # its rows are packed by itself: the others are given back first
    errors["svm"] = KS.fold_errors(rows, feats, "label", "fold", FOLDS, gamma=SVM_GAMMAS[-1], cost=1.0)
    return spark.createDataFrame([(m, 1.0 - float(np.mean(e)), len(e)) for m, e in errors.items()],
                                 "model string, cv_accuracy double, n_folds long")


def _place(row, names, fit):
    row[0] = fit.coef[0]
    for t, b in zip(fit.terms[1:], fit.coef[1:]):
        row[1 + names.index(t)] = b


@register("fold_lm_one_factor", f"""
WITH d AS (SELECT CAST(l_quantity > 25 AS INTEGER) AS label, l_returnflag AS g, {_FOLD.format(seed=7, op='% 5', kind='INTEGER')} AS fold FROM lineitem),
s AS (SELECT fold, g, sum(label) AS s, count(*) AS n FROM d GROUP BY fold, g),
t AS (SELECT g, sum(s) AS s, sum(n) AS n FROM s GROUP BY g),
m AS (SELECT s.fold, s.g, (t.s - s.s)::DOUBLE / (t.n - s.n) AS fitted FROM s JOIN t ON s.g = t.g)
SELECT fold, l_returnflag, round(fitted, 8) AS fitted, n, n_wrong FROM (
    SELECT d.fold, d.g AS l_returnflag, fitted, count(*) AS n, count(*) FILTER (WHERE (fitted >= 0.5) <> (label = 1)) AS n_wrong
    FROM d JOIN m ON d.fold = m.fold AND d.g = m.g GROUP BY d.fold, d.g, fitted)
""")
def fold_lm_one_factor(spark, d):
    """Linear model of the label on the return flag, fitted outside each fold
    from one scan: fitted value per level and the errors on the fold."""
    li = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 25).cast("double").alias("label"), "l_returnflag")
    levels = FE.factor_levels(li, "l_returnflag")
    li, names = FE.dummy_columns(li, "l_returnflag", levels)
    li = SP.kfold(li, ["l_orderkey", "l_linenumber"], FOLDS, seed=7)
    data = li.select(*[F.col(c).cast("double") for c in names], "label", F.col("fold").cast("double"))
    fits = [ols.ols_from_gram(g) for g in folds.training_grams(data, names, "label", "fold", FOLDS)]
    rows = []
    for k, fit in enumerate(fits):
        b = dict(zip(fit.terms, fit.coef))
        rows += [(k, lv, float(fit.coef[0] + b.get(FE.level_name("l_returnflag", lv), 0.0))) for lv in levels]
    table = spark.createDataFrame(rows, "fold int, l_returnflag string, fitted double")       # folds x levels
    wrong = (F.col("fitted") >= 0.5) != (F.col("label") == 1)
    return (li.select("fold", "l_returnflag", "label").join(F.broadcast(table), ["fold", "l_returnflag"])
            .groupBy("fold", "l_returnflag", F.round("fitted", 8).alias("fitted"))
            .agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("n_wrong")))


@register("obs_vs_fitted")
def obs_vs_fitted(spark, d):
    """Observed, fitted and residual of the additive model for every training row."""
    li, fit = _fit_gam(spark, d)
    train = li.where(F.col("is_train") == 1).withColumn("fitted", fit.fitted())
    return train.select("l_orderkey", "l_linenumber", F.col("y").alias("observed"), "fitted",
                        (F.col("y") - F.col("fitted")).alias("residual"))


POISSON_X = ["discount_avg", "tax_avg", "share_weekend", "balance_k", "supplier_rich"]


def poisson_frame(spark, d):
    from panelkit.operators import panel as P
    li = T.lineitem_panel(spark, d)
    m = P.monthly_rollup(li, "l_suppkey", "date", (F.col("l_quantity") > 25).cast("int"),
                         {"discount_avg": F.col("l_discount"), "tax_avg": F.col("l_tax"),
                          "share_weekend": (F.weekday("date") >= 5).cast("double")})
    s = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal", "s_nationkey")
    return m.join(s, "l_suppkey").withColumns({"supplier_rich": (F.col("s_acctbal") > 4500).cast("int"),
                                               "balance_k": F.col("s_acctbal") / 1000})


def mean_scores(df, fit, y, offset=None):
    """(term, mean_score, n): the mean of (y - fitted mean) times each column.
    These are the equations a maximum-likelihood fit solves, so all are 0."""
    eta = F.col(offset) if offset else F.lit(0.0)
    for t, b in zip(fit.terms, fit.estimate):
        eta = eta + F.lit(float(b)) * (F.lit(1.0) if t == glm.INTERCEPT else F.col(t))
    mu = F.exp(eta) if fit.family == "poisson" else 1 / (1 + F.exp(-eta))
    left = df.withColumn("_left", F.col(y) - mu)
    one = left.agg(F.count(F.lit(1)).alias("n"), *[
        F.abs(F.round(F.avg(F.col("_left") * (F.lit(1.0) if t == glm.INTERCEPT else F.col(t))), 6)).alias(f"s{i}")
        for i, t in enumerate(fit.terms)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"s{i}").alias("mean_score"), F.col("n"))
                                         for i, t in enumerate(fit.terms)])))


@register("poisson_score", """
WITH m AS (SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS ym FROM lineitem GROUP BY 1, 2)
SELECT term, CAST(0 AS DOUBLE) AS mean_score, (SELECT count(*) FROM m) AS n
FROM (VALUES ('(Intercept)'), ('discount_avg'), ('tax_avg'), ('share_weekend'), ('balance_k'), ('supplier_rich')) t(term)
""")
def poisson_score(spark, d):
    m = poisson_frame(spark, d)
    return mean_scores(m, glm.fit_glm(m, "n_high_days", POISSON_X, "poisson", offset="log_n_days", pearson=False), "n_high_days", "log_n_days")


@register("logit_score", """
WITH b AS (SELECT CAST(('0x' || substr(md5(CAST(l_orderkey AS VARCHAR) || '#' || CAST(l_linenumber AS VARCHAR) || '#42'), 1, 8)) AS BIGINT) AS h FROM lineitem)
SELECT term, CAST(0 AS DOUBLE) AS mean_score, (SELECT count(*) FROM b WHERE h < CAST(trunc(0.8 * 4294967296) AS BIGINT)) AS n
FROM (VALUES ('(Intercept)'), ('log_price_z'), ('l_discount_z'), ('l_tax_z'), ('l_returnflag_N'), ('l_returnflag_R'), ('l_linestatus_O')) t(term)
""")
def logit_score(spark, d):
    li, feats = class_frame(spark, d)
    train = li.where(F.col("is_train") == 1)
    return mean_scores(train, glm.fit_glm(train, "label", feats, "binomial", pearson=False), "label")


@register("poisson_full")
def poisson_full(spark, d):
    """Count chain with several predictors: entity-month counts with a
    log-exposure offset -> Poisson fit -> rate ratios with Wald intervals,
    deviance/Pearson dispersion and quasi-Poisson standard errors."""
    from panelkit import constants as K
    fit = glm.fit_glm(poisson_frame(spark, d), "n_high_days", POISSON_X, "poisson", offset="log_n_days")
    disp = glm.dispersion_row(fit, K.OVERDISPERSION_FLAG)
    quasi = {t: (sq, pq) for t, _b, _s, _p, sq, _tq, pq in fit.quasi_rows()}
    rows = [(t, b, s_, z, p, rr, lo, hi, quasi[t][0], quasi[t][1]) for t, b, s_, z, p, rr, lo, hi in fit.coef_rows()]
    t = spark.createDataFrame(rows, "term string, estimate double, std_error double, z_value double, "
                                    "p_value double, rate_ratio double, rr_ci_low double, rr_ci_high double, "
                                    "se_quasi double, p_quasi double")
    return t.withColumns({"deviance": F.lit(disp["deviance"]), "df_residual": F.lit(disp["df_residual"]),
                          "deviance_ratio": F.lit(disp["deviance_ratio"]),
                          "pearson_ratio": F.lit(disp["pearson_ratio"]),
                          "overdispersed": F.lit(disp["overdispersed"]), "aic": F.lit(fit.aic),
                          "null_deviance": F.lit(fit.null_deviance)})


@register("logit_full")
def logit_full(spark, d):
    """Binomial chain: several predictors on the training split -> odds
    ratios with intervals and a significance flag; held-out AUC and
    classification metrics at the 0.5 cut."""
    li, feats = class_frame(spark, d)
    train, test = li.where(F.col("is_train") == 1), li.where(F.col("is_train") == 0)
    fit = glm.fit_glm(train, "label", feats, "binomial", pearson=False)
    scored = glm.predict(fit, test, feats, "prob").withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    held = EV.auc(scored, "label", "prob").select(F.col("auc").alias("test_auc")).crossJoin(F.broadcast(
        EV.class_metrics(scored, "label", "pred").select(F.col("accuracy").alias("test_accuracy"),
                                                         F.col("sensitivity").alias("test_sensitivity"), F.col("specificity").alias("test_specificity"))))
    z = dists_norm_975()
    rows = [(t, b, s_, zv, p, orr, lo, hi, int(abs(zv) > z)) for t, b, s_, zv, p, orr, lo, hi in fit.coef_rows()]
    out = spark.createDataFrame(rows, "term string, estimate double, std_error double, z_value double, "
                                      "p_value double, odds_ratio double, or_ci_low double, or_ci_high double, "
                                      "significant int")
    return out.crossJoin(F.broadcast(held))


def dists_norm_975() -> float:
    from panelkit.functions import dists
    return dists.norm_ppf(0.975)
