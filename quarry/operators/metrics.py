"""Evaluation metrics over a scored table ``(label, prediction[, score / class scores])``.

Classification metrics come from the confusion counts (one ``groupBy`` on
(label, prediction), at most classes^2 rows). Rank metrics (ROC AUC, ROC
curve) use distributed prefix sums over distinct scores. Regression metrics
are one ``agg`` plus an exact distributed median.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.frames import one_row_join, q
from quarry.functions.ranks import exact_quantiles_long, prefix_counts

# float64 machine epsilon (clip for log loss, MAPE denominator floor).
EPS = 2.220446049250313e-16


# ---------------------------------------------------------------- classification

def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """``(actual, predicted, count)`` for observed pairs; classes^2 rows at most."""
    return df.groupBy(q(label).cast("string").alias("actual"), q(prediction).cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).alias("count")
    )


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction",
              counts: DataFrame | None = None) -> DataFrame:
    """``(class, tp, n_pred, support, precision, recall, f1)`` over the union of true and predicted labels.

    Undefined ratios count as 0 (zero-division rule).
    """
    c = counts if counts is not None else confusion_counts(df, label, prediction)
    as_true = c.groupBy(F.col("actual").alias("class")).agg(F.sum("count").alias("support"),
                                                           F.sum(F.when(F.col("actual") == F.col("predicted"),
                                                                        F.col("count")).otherwise(0)).alias("tp"))
    as_pred = c.groupBy(F.col("predicted").alias("class")).agg(F.sum("count").alias("n_pred"))
    j = as_true.join(as_pred, "class", "full").select(
        "class", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("n_pred", F.lit(0)).alias("n_pred"),
        F.coalesce("support", F.lit(0)).alias("support"),
    )
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    j = j.withColumn("precision", prec.cast("double")).withColumn("recall", rec.cast("double"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return j.withColumn("f1", f1)


def classification_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and support-weighted precision, recall, F1, all x100 at 2 dp."""
    pc = per_class(df, label, prediction)
    agg = pc.agg(
        (F.sum("tp") / F.sum("support")).alias("_acc"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("_p"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("_r"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("_f"),
    )
    return agg.select(*[F.round(F.col(a) * 100, 2).alias(n) for a, n in
                        (("_acc", "accuracy"), ("_p", "precision"), ("_r", "recall"), ("_f", "f1"))])


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.round(F.avg(F.when(q(label).cast("string") == q(prediction).cast("string"), 1.0).otherwise(0.0)) * 100,
                          2).alias("accuracy"))


def weighted_precision(df, label="label", prediction="prediction"):
    return classification_scores(df, label, prediction).select("precision")


def weighted_recall(df, label="label", prediction="prediction"):
    return classification_scores(df, label, prediction).select("recall")


def weighted_f1(df, label="label", prediction="prediction"):
    return classification_scores(df, label, prediction).select("f1")


def _auc_by_group(long_df: DataFrame, group_cols: Sequence[str]) -> DataFrame:
    """Mann-Whitney AUC per group from ``(group..., score, pos)`` rows, ties averaged."""
    group_cols = list(group_cols)
    d = long_df.groupBy(*group_cols, "score").agg(F.count(F.lit(1)).alias("cnt"), F.sum("pos").alias("npos"))
    r = prefix_counts(d, group_cols, "score", "cnt")
    avg_rank = F.col("before") + (F.col("cnt") + 1) / 2.0
    agg = r.groupBy(*group_cols).agg(F.sum(avg_rank * F.col("npos")).alias("_rs"), F.sum("npos").alias("_p"),
                                     F.sum("cnt").alias("_n"))
    neg = F.col("_n") - F.col("_p")
    auc = F.when((F.col("_p") > 0) & (neg > 0),
                 (F.col("_rs") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * neg))
    return agg.select(*group_cols, auc.alias("auc"), F.col("_p").alias("support"))


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", positive=1, digits: int = 4) -> DataFrame:
    """Binary ROC AUC from a positive-class score; exact (rank form), 4 dp."""
    long = df.select(F.lit(0).alias("_g"), q(score).cast("double").alias("score"),
                     F.when(q(label) == F.lit(positive), 1).otherwise(0).alias("pos"))
    return _auc_by_group(long, ["_g"]).select(F.round("auc", digits).alias("roc_auc"))


def roc_auc_ovr(df: DataFrame, classes: Sequence[str], score_cols: Sequence[str], label: str = "label",
                digits: int = 4) -> DataFrame:
    """Multiclass one-vs-rest AUC weighted by class support; null if any class has no positive or negative."""
    cells = [F.struct(F.lit(c).alias("class"), q(s).cast("double").alias("score"),
                      F.when(q(label).cast("string") == F.lit(c), 1).otherwise(0).alias("pos"))
             for c, s in zip(classes, score_cols)]
    long = df.select(F.inline(F.array(*cells)))
    per = _auc_by_group(long, ["class"])
    agg = per.agg(F.sum(F.col("auc") * F.col("support")).alias("_w"), F.sum("support").alias("_s"),
                  F.count_if(F.col("auc").isNull()).alias("_bad"))
    return agg.select(F.when(F.col("_bad") == 0, F.round(F.col("_w") / F.col("_s"), digits)).alias("roc_auc"))


def log_loss(df: DataFrame, classes: Sequence[str], score_cols: Sequence[str], label: str = "label",
             digits: int = 4) -> DataFrame:
    """Mean negative log probability of the true class; rows renormalised, clipped to [eps, 1-eps]."""
    total = sum((q(s) for s in score_cols), F.lit(0.0))
    p_true = F.lit(None).cast("double")
    for c, s in zip(reversed(list(classes)), reversed(list(score_cols))):
        p_true = F.when(q(label).cast("string") == F.lit(c), q(s) / total).otherwise(p_true)
    clipped = F.greatest(F.least(p_true, F.lit(1 - EPS)), F.lit(EPS))
    return df.agg(F.round(F.avg(-F.ln(clipped)), digits).alias("log_loss"))


def binary_log_loss(df: DataFrame, label: str = "label", score: str = "score", positive=1, digits: int = 4) -> DataFrame:
    s = q(score).cast("double")
    p_true = F.when(q(label) == F.lit(positive), s).otherwise(1 - s)
    clipped = F.greatest(F.least(p_true, F.lit(1 - EPS)), F.lit(EPS))
    return df.agg(F.round(F.avg(-F.ln(clipped)), digits).alias("log_loss"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     labels: Sequence[str] | None = None) -> DataFrame:
    """Long ``(actual, predicted, count)`` over the sorted label set (or the given labels); zero cells kept."""
    c = confusion_counts(df, label, prediction)
    if labels is None:
        names = c.select(F.col("actual").alias("l")).union(c.select(F.col("predicted").alias("l")))
        arr = names.agg(F.array_sort(F.collect_set("l")).alias("ls"))
    else:
        arr = df.sparkSession.range(1).select(F.array(*[F.lit(str(x)) for x in labels]).alias("ls"))
    # the label set is bounded by the number of classes: build the grid by exploding it twice
    grid = arr.select(F.explode("ls").alias("actual"), "ls").select("actual", F.explode("ls").alias("predicted"))
    return grid.join(c, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          digits: int = 4) -> DataFrame:
    """Per class precision, recall, f1, support; plus accuracy, macro avg and weighted avg rows."""
    pc = per_class(df, label, prediction)
    r = lambda c: F.round(c, digits)
    classes = pc.select(F.col("class").alias("label"), r(F.col("precision")).alias("precision"),
                        r(F.col("recall")).alias("recall"), r(F.col("f1")).alias("f1"),
                        F.col("support").cast("bigint").alias("support"))
    agg = pc.agg(F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
                 (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
                 (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
                 (F.sum("tp") / F.sum("support")).alias("acc"), F.sum("support").cast("bigint").alias("n"))
    macro = agg.select(F.lit("macro avg").alias("label"), r(F.col("mp")).alias("precision"), r(F.col("mr")).alias("recall"),
                       r(F.col("mf")).alias("f1"), F.col("n").alias("support"))
    weighted = agg.select(F.lit("weighted avg").alias("label"), r(F.col("wp")).alias("precision"),
                          r(F.col("wr")).alias("recall"), r(F.col("wf")).alias("f1"), F.col("n").alias("support"))
    acc = agg.select(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), r(F.col("acc")).alias("f1"), F.col("n").alias("support"))
    return classes.unionByName(macro).unionByName(weighted).unionByName(acc)


# ---------------------------------------------------------------- regression

def _reg_parts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, p = q(label).cast("double"), q(prediction).cast("double")
    return df.select(y.alias("y"), p.alias("p"), (y - p).alias("e"))


def regression_scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: mae, mse, rmse, r2, explained_variance, median_absolute_error (4 dp), mape (2 dp)."""
    t = _reg_parts(df, label, prediction)
    agg = t.agg(
        F.avg(F.abs("e")).alias("mae"), F.avg(F.col("e") * F.col("e")).alias("mse"),
        F.var_pop("y").alias("vy"), F.var_pop("e").alias("ve"), F.count(F.lit(1)).alias("n"),
        F.avg(F.abs("e") / F.greatest(F.abs("y"), F.lit(EPS))).alias("mape"),
    )
    med = exact_quantiles_long(t.select(F.lit(0).alias("_g"), F.abs("e").alias("ae")), ["_g"], "ae", (0.5,))
    j = one_row_join(agg, med.select(F.col("q").alias("medae")))
    # SSE / SST = mse / var_pop(y); a constant label gives 1 for a perfect fit, else 0
    r2 = F.when(F.col("vy") > 0, 1 - F.col("mse") / F.col("vy")).when(F.col("mse") == 0, 1.0).otherwise(0.0)
    ev = F.when(F.col("vy") > 0, 1 - F.col("ve") / F.col("vy")).when(F.col("ve") == 0, 1.0).otherwise(0.0)
    return j.select(
        F.round("mae", 4).alias("mae"), F.round("mse", 4).alias("mse"), F.round(F.sqrt("mse"), 4).alias("rmse"),
        F.round(r2, 4).alias("r2"), F.round(ev, 4).alias("explained_variance"),
        F.round("medae", 4).alias("median_absolute_error"), F.round(F.col("mape") * 100, 2).alias("mape"),
    )


def mae(df, label="label", prediction="prediction"):
    return regression_scores(df, label, prediction).select("mae")


def mse(df, label="label", prediction="prediction"):
    return regression_scores(df, label, prediction).select("mse")


def rmse(df, label="label", prediction="prediction"):
    return regression_scores(df, label, prediction).select("rmse")


def r2(df, label="label", prediction="prediction"):
    return regression_scores(df, label, prediction).select("r2")


def explained_variance(df, label="label", prediction="prediction"):
    return regression_scores(df, label, prediction).select("explained_variance")


def median_absolute_error(df, label="label", prediction="prediction"):
    return regression_scores(df, label, prediction).select("median_absolute_error")


def mape(df, label="label", prediction="prediction"):
    return regression_scores(df, label, prediction).select("mape")


def evaluate(df: DataFrame, problem_type: str, label: str = "label", prediction: str = "prediction",
             score: str | None = None, classes: Sequence[str] | None = None,
             score_cols: Sequence[str] | None = None) -> DataFrame:
    """All metrics of the problem type as one row; unknown type -> ValueError.

    With ``score`` (binary) or ``classes`` + ``score_cols`` (multiclass) also
    ``roc_auc`` and ``log_loss``.
    """
    if problem_type == "classification":
        out = classification_scores(df, label, prediction)
        if score is not None:
            out = one_row_join(one_row_join(out, roc_auc(df, label, score)), binary_log_loss(df, label, score))
        elif classes is not None and score_cols is not None:
            out = one_row_join(one_row_join(out, roc_auc_ovr(df, classes, score_cols, label)),
                               log_loss(df, classes, score_cols, label))
        return out
    if problem_type == "regression":
        return regression_scores(df, label, prediction)
    raise ValueError(f"Unsupported problem type: {problem_type}")


PRIMARY = {"classification": "accuracy", "regression": "r2"}


def metric_leaderboard(results: DataFrame, problem_type: str, metric: str | None = None,
                       name_col: str = "model") -> DataFrame:
    """Rank rows ``(model, metrics...)`` on the primary metric (descending, then name)."""
    metric = metric or PRIMARY[problem_type]
    # one row per model: a small table
    w = Window.orderBy(F.col(metric).desc_nulls_last(), F.col(name_col))
    return results.withColumn("rank", F.row_number().over(w))


def best_model(board: DataFrame, metric: str, name_col: str = "model") -> DataFrame:
    return board.agg(F.max_by(F.col(name_col), F.col(metric)).alias("best_model"))


def roc_curve_points(df: DataFrame, label: str = "label", score: str = "score", positive=1,
                     digits: int = 6) -> DataFrame:
    """``(threshold, fpr, tpr)`` for every distinct score, highest threshold first (all points kept)."""
    long = df.select(F.lit(0).alias("_g"), (-q(score).cast("double")).alias("neg_score"),
                     F.when(q(label) == F.lit(positive), 1).otherwise(0).alias("pos"))
    d = long.groupBy("_g", "neg_score").agg(F.count(F.lit(1)).alias("cnt"), F.sum("pos").alias("npos"))
    r = prefix_counts(d, ["_g"], "neg_score", ["cnt", "npos"])
    tot = d.groupBy("_g").agg(F.sum("cnt").alias("_n"), F.sum("npos").alias("_p"))
    j = r.join(F.broadcast(tot), "_g")
    tps = F.col("before_npos") + F.col("npos")
    fps = F.col("before_cnt") + F.col("cnt") - tps
    return j.select(
        (-F.col("neg_score")).alias("threshold"),
        F.round(F.try_divide(fps, F.col("_n") - F.col("_p")), digits).alias("fpr"),
        F.round(F.try_divide(tps, F.col("_p")), digits).alias("tpr"),
    )


def residual_histogram(df: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = 30) -> DataFrame:
    """30-bin histogram of residuals (actual - predicted)."""
    from quarry.operators.eda import histograms

    res = df.select((q(label).cast("double") - q(prediction).cast("double")).alias("residual"))
    return histograms(res, ["residual"], bins=bins)


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = q(label).cast("double"), q(prediction).cast("double")
    return df.select(y.alias("actual"), p.alias("predicted"), (y - p).alias("residual"))



