"""Scoring predictions: confusion counts, ranking metrics, comparisons over seeds.

Curves are built from counts per distinct score, with running sums over score
ranges, so a fold of any size and a score shared by any number of rows are fine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rank import group_median
from .scale import cut_points, range_bucket, running_sum


def confusion(pred: DataFrame, by=("fold",)) -> DataFrame:
    """TN, FP, FN and TP per group."""
    cell = lambda y, p: F.sum(F.when((F.col("label") == y) & (F.col("pred") == p), 1).otherwise(0))
    return pred.groupBy(*by).agg(cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))


def score_curve(pred: DataFrame, by=("fold",), cuts=None) -> DataFrame:
    """Per group and distinct score, from the top: counts at the score and up to it.

    Columns: score, pos, neg (at the score), tp, fp, point (up to and including it).
    """
    pos, neg = F.sum(F.when(F.col("label") == 1, 1).otherwise(0)), F.sum(F.when(F.col("label") == 0, 1).otherwise(0))
    at = pred.groupBy(*by, "score").agg(pos.alias("pos"), neg.alias("neg"))
    cuts = cut_points(pred, "score") if cuts is None else cuts
    measures = {"tp": F.col("pos"), "fp": F.col("neg"), "point": F.lit(1)}
    return running_sum(at, by, [F.desc("score")], -range_bucket(F.col("score"), cuts), measures)


def ranking_metrics(pred: DataFrame, by=("fold",), cuts=None) -> DataFrame:
    """ROC AUC (ties count half), area under the PR curve (trapezoid) and average precision."""
    c = score_curve(pred, by, cuts)
    tp0, fp0 = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(tp0 + fp0 > 0, tp0 / F.greatest(tp0 + fp0, F.lit(1))).otherwise(1.0)
    sums = c.groupBy(*by).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.sum(F.col("neg") * (2 * tp0 + F.col("pos"))).alias("_auc2"),
        F.sum(F.col("pos") * (precision + before) / 2).alias("_aupr"), F.sum(F.col("pos") * precision).alias("_ap"),
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return sums.select(
        *by, F.when(both, F.col("_auc2") / (2.0 * F.col("_p") * F.col("_n"))).alias("auc"),
        F.when(F.col("_p") > 0, F.col("_aupr") / F.col("_p")).alias("aupr"), F.when(F.col("_p") > 0, F.col("_ap") / F.col("_p")).alias("ap"),
    )


def prf(pred: DataFrame, average: str = "binary", by=("fold",)) -> DataFrame:
    """Accuracy, precision, recall and F1: of class 1, or weighted or macro over both classes."""
    c = confusion(pred, by)
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    total = tn + fp + fn + tp
    classes = {1: (ratio(tp, tp + fp), ratio(tp, tp + fn), tp + fn), 0: (ratio(tn, tn + fn), ratio(tn, tn + fp), tn + fp)}
    f1 = lambda p, r: ratio(2 * p * r, p + r)
    share = {"binary": {1: F.lit(1.0), 0: F.lit(0.0)}, "macro": {1: F.lit(0.5), 0: F.lit(0.5)}, "weighted": {k: v[2] / total for k, v in classes.items()}}[average]
    mix = lambda pick: sum((share[k] * pick(*classes[k][:2]) for k in (1, 0)), F.lit(0.0))
    return c.select(
        *by, ((tp + tn) / total).alias("accuracy"), mix(lambda p, r: p).alias("precision"), mix(lambda p, r: r).alias("recall"), mix(f1).alias("f1")
    )


def best_threshold(pred: DataFrame, by=("fold",), skip: int = 5, cuts=None) -> DataFrame:
    """Score that maximises F1 on the ROC points, with sensitivity and specificity there.

    Precision is taken as tpr / (tpr + fpr). The first ``skip`` points, counting the
    origin, are left out; ties go to the higher score.
    """
    c = score_curve(pred, by, cuts)
    totals = c.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    c = c.join(totals, list(by)).filter((F.col("_p") > 0) & (F.col("_n") > 0) & (F.col("point") >= skip))
    tpr, fpr = F.col("tp") / F.col("_p"), F.col("fp") / F.col("_n")
    prec = tpr / (tpr + fpr)
    f1 = F.round(2 * prec * tpr / (tpr + prec + 0.00001), 12)
    best = c.select(*by, F.struct(f1.alias("f1"), "score", tpr.alias("tpr"), fpr.alias("fpr")).alias("b")).groupBy(*by).agg(F.max("b").alias("b"))
    return best.select(*by, F.col("b.score").alias("threshold"), "b.f1", F.col("b.tpr").alias("sensitivity"), (1 - F.col("b.fpr")).alias("specificity"))


def ap_at_k(pred: DataFrame, k: int, by=("fold",)) -> DataFrame:
    """Average precision of the k best scores, over min(k, number of positives)."""
    w = W.partitionBy(*by).orderBy(F.desc("score"), "dst", "src")
    top = pred.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    upto = W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, 0)
    top = top.withColumn("_hits", F.sum("label").over(upto))
    gain = top.groupBy(*by).agg(F.sum(F.when(F.col("label") == 1, F.col("_hits") / F.col("_r")).otherwise(0.0)).alias("_g"))
    total = pred.groupBy(*by).agg(F.sum("label").alias("_p"))
    return total.join(gain, list(by)).select(*by, F.when(F.col("_p") > 0, F.col("_g") / F.least(F.col("_p"), F.lit(k))).otherwise(0.0).alias("ap"))


def regression_errors(df: DataFrame, by: str = "fold", value: str = "y", fitted: str = "score") -> DataFrame:
    """Mean squared error, median absolute error and R² per group."""
    err = F.col(value) - F.col(fitted)
    mse = df.groupBy(by).agg(F.avg(err * err).alias("mse"), F.var_pop(value).alias("_v"))
    med = group_median(df.select(by, F.abs(err).alias("_abs")), by, "_abs").withColumnRenamed("median", "median_abs_error")
    out = mse.join(med, by)
    return out.select(by, "mse", "median_abs_error", F.when(F.col("_v") > 0, 1 - F.col("mse") / F.col("_v")).alias("r2"))


def paired_signed_rank(df: DataFrame, a: str, b: str, cuts=None) -> DataFrame:
    """Signed-rank statistic of paired values: rank sums by sign and their minimum.

    Zero differences are left out; equal sizes share the mean of their ranks.
    """
    d = df.select((F.col(a) - F.col(b)).alias("d")).filter(F.col("d") != 0).select(F.abs("d").alias("size"), F.when(F.col("d") > 0, 1).otherwise(0).alias("up"))
    at = d.groupBy("size").agg(F.count("*").alias("n"), F.sum("up").alias("up"))
    cuts = cut_points(d, "size") if cuts is None else cuts
    r = running_sum(at, [], ["size"], range_bucket(F.col("size"), cuts), {"upto": F.col("n")})
    rank = F.col("upto") - (F.col("n") - 1) / 2
    sums = r.agg(F.sum("n").alias("n"), F.sum(rank * F.col("up")).alias("w_plus"), F.sum(rank * (F.col("n") - F.col("up"))).alias("w_minus"))
    return sums.withColumn("w", F.least("w_plus", "w_minus"))


def negative_coverage(neg: DataFrame, targets: DataFrame) -> DataFrame:
    """Percent of targets that occur among the negatives."""
    n = targets.agg(F.count_distinct("dst").alias("_all"))
    return neg.agg(F.count_distinct("dst").alias("n_used")).join(F.broadcast(n)).select("n_used", F.round(F.lit(100.0) * F.col("n_used") / F.col("_all"), 2).alias("percent"))
