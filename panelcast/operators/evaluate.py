"""Evaluation of scored rows as DataFrame operators.

Input: predictions(<keys...>, Target, prediction, probability).  Two tables carry
everything:

* the confusion table - one grouped aggregation with four conditional sums (E1),
  from which accuracy / precision / recall / specificity / F1 / reports follow;
* the score curve - one row per distinct score with its positive / negative counts
  and the cumulative counts at or above it (E8-E15).

The cumulative sums are a two-level parallel scan, so no key group ever has to sit
in one task: distinct scores are cut into ordered ranges at approximate quantiles
(one small sketch per key group), range totals get running offsets over a table of
(groups x ranges) rows, and each row adds its in-range running sum to its offset.
Zero divisions follow the reference: precision / recall / F1 of an empty class are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

DEFAULT_KEYS = ("model", "fold")
METRIC_NAMES = ["Accuracy", "Precision", "Recall", "Specificity", "F1-Score"]


def ratio0(n: Column, d: Column) -> Column:
    """n / d, 0.0 when d == 0 (sklearn's zero_division=0)."""
    return F.when(d != 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def threshold_predictions(preds: DataFrame, threshold: float, score: str = "probability") -> DataFrame:
    """prediction = score >= threshold."""
    return preds.withColumn("prediction", (F.col(score) >= F.lit(threshold)).cast("int"))


# ------------------------------------------------------------------ confusion family


def confusion(preds: DataFrame, keys=DEFAULT_KEYS, label: str = "Target", pred: str = "prediction") -> DataFrame:
    """Tn, fp, fn, tp per key group (one aggregation, map-side partial sums)."""
    y, p = F.col(label), F.col(pred)

    def cnt(c):
        return F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))

    return preds.groupBy(*keys).agg(
        cnt((y == 0) & (p == 0)).alias("tn"),
        cnt((y == 0) & (p == 1)).alias("fp"),
        cnt((y == 1) & (p == 0)).alias("fn"),
        cnt((y == 1) & (p == 1)).alias("tp"),
    )


def metric_columns(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """E3-E7 from counts; F1 = 2tp / (2tp + fp + fn), 0 when undefined."""
    n = tn + fp + fn + tp
    return {
        "accuracy": ratio0(tp + tn, n),
        "precision": ratio0(tp, tp + fp),
        "recall": ratio0(tp, tp + fn),
        "specificity": ratio0(tn, tn + fp),
        "f1": ratio0(2 * tp, 2 * tp + fp + fn),
    }


def binary_metrics(conf: DataFrame) -> DataFrame:
    """Metrics plus the row-normalised confusion matrix."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return conf.withColumns(
        {
            **metric_columns(tn, fp, fn, tp),
            "tn_rate": ratio0(tn, tn + fp),
            "fp_rate": ratio0(fp, tn + fp),
            "fn_rate": ratio0(fn, fn + tp),
            "tp_rate": ratio0(tp, fn + tp),
        }
    )


def classification_report(conf: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """Per class (Down, Up) precision / recall / F1 / support, plus accuracy,
    macro and support-weighted averages - one row per (keys, label)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    down = {"p": ratio0(tn, tn + fn), "r": ratio0(tn, tn + fp), "f": ratio0(2 * tn, 2 * tn + fn + fp), "s": tn + fp}
    up = {"p": ratio0(tp, tp + fp), "r": ratio0(tp, tp + fn), "f": ratio0(2 * tp, 2 * tp + fp + fn), "s": fn + tp}

    def row(label, p, r, f, s):
        return F.struct(
            F.lit(label).alias("label"),
            p.cast("double").alias("precision"),
            r.cast("double").alias("recall"),
            f.cast("double").alias("f1_score"),
            s.cast("long").alias("support"),
        )

    def wavg(k):
        return ratio0(down[k] * down["s"] + up[k] * up["s"], n)

    rows = F.array(
        row("Down", down["p"], down["r"], down["f"], down["s"]),
        row("Up", up["p"], up["r"], up["f"], up["s"]),
        row("accuracy", F.lit(None), F.lit(None), ratio0(tp + tn, n), n),
        row("macro avg", (down["p"] + up["p"]) / 2, (down["r"] + up["r"]) / 2, (down["f"] + up["f"]) / 2, n),
        row("weighted avg", wavg("p"), wavg("r"), wavg("f"), n),
    )
    return conf.select(*keys, F.inline(rows))


def confusion_breakdown(conf: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """Totals, correct / incorrect, actual and predicted class counts and shares.

    Actual classes are tn+fp (Down) and fn+tp (Up); predicted ones tn+fn and fp+tp
    (the reference labels the predicted counts as actual, Q8).
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    return conf.select(
        *keys,
        n.alias("total"),
        (tp + tn).alias("correct"),
        (fp + fn).alias("incorrect"),
        (tn + fp).alias("actual_down"),
        (fn + tp).alias("actual_up"),
        (tn + fn).alias("predicted_down"),
        (fp + tp).alias("predicted_up"),
        ratio0(tn + fp, n).alias("actual_down_share"),
        ratio0(fn + tp, n).alias("actual_up_share"),
        ratio0(tn + fn, n).alias("predicted_down_share"),
        ratio0(fp + tp, n).alias("predicted_up_share"),
    )


# ------------------------------------------------------------------ score curve


def score_curve(
    preds: DataFrame,
    keys=DEFAULT_KEYS,
    label: str = "Target",
    score: str = "probability",
    range_rows: int = 1 << 18,
    broadcast_groups: int = 100_000,
) -> DataFrame:
    """Per key group and distinct score s: pos, neg at s; tp, fp = counts with score >= s;
    P, N = class totals.  Cumulative sums use the two-level scan described above.

    The predictions are read once: their distinct scores are written, and counted, so that
    the number of ranges follows from them (about `range_rows` scores each)."""
    keys = list(keys)
    y = F.col(label)
    g = preds.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum((y == 1).cast("long")).alias("pos"), F.sum((y == 0).cast("long")).alias("neg")
    )
    g = materialize(g, "scores")
    n_groups, most = g.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.max("n")).first()
    ranges = max(1, -(-(most or 0) // range_rows))
    if ranges == 1:
        gr = g.withColumn("_rng", F.lit(0))
    else:
        cuts = g.groupBy(*keys).agg(
            F.percentile_approx("score", [i / ranges for i in range(1, ranges)], max(10_000, 10 * ranges)).alias("_cuts")
        )
        # One array of `ranges` doubles per key group (models x folds), broadcast below the
        # limit, so the distinct scores are never shuffled by key group.
        side = F.broadcast(cuts) if n_groups <= broadcast_groups else cuts
        gr = g.join(side, keys).withColumn("_rng", _cuts_above("_cuts", "score", ranges - 1)).drop("_cuts")
    per_range = gr.groupBy(*keys, "_rng").agg(F.sum("pos").alias("_rp"), F.sum("neg").alias("_rn"))
    before = Window.partitionBy(*keys).orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(*keys)
    offsets = per_range.select(
        *keys,
        "_rng",
        F.coalesce(F.sum("_rp").over(before), F.lit(0)).alias("_op"),
        F.coalesce(F.sum("_rn").over(before), F.lit(0)).alias("_on"),
        F.sum("_rp").over(total).alias("P"),
        F.sum("_rn").over(total).alias("N"),
    )
    inside = Window.partitionBy(*keys, "_rng").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        gr.join(offsets, [*keys, "_rng"])
        .withColumns(
            {
                "tp": F.col("_op") + F.sum("pos").over(inside),
                "fp": F.col("_on") + F.sum("neg").over(inside),
            }
        )
        .select(*keys, "score", "pos", "neg", "tp", "fp", "P", "N")
    )


def _cuts_above(cuts: str, value: str, n: int) -> Column:
    """Number of the n ascending `cuts` greater than `value`: a look among every step-th one, then
    among the step cuts around it."""
    step = max(1, int(n**0.5))
    coarse = F.filter(F.sequence(F.lit(0), F.lit(n - 1), F.lit(step)), lambda i: F.get(F.col(cuts), i) <= F.col(value))
    base = F.greatest(F.size(coarse) - 1, F.lit(0)) * step
    near = F.filter(F.slice(F.col(cuts), base + 1, F.lit(step)), lambda c: c <= F.col(value))
    return F.lit(n) - base - F.size(near)


def _totals(curve: DataFrame, keys) -> DataFrame:
    return curve.groupBy(*keys).agg(F.first("P").alias("P"), F.first("N").alias("N"))


def roc_auc(curve: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """Area under the ROC curve with tied scores counted half (exact, no binning)."""
    keys = list(keys)
    pairs = F.col("neg").cast("double") * (F.col("tp").cast("double") - F.col("pos").cast("double") / 2)
    out = curve.groupBy(*keys).agg(F.sum(pairs).alias("_s"), F.first("P").alias("P"), F.first("N").alias("N"))
    den = F.col("P").cast("double") * F.col("N").cast("double")
    return out.select(*keys, F.when(den > 0, F.col("_s") / den).alias("auc"))


def roc_points(curve: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """(fpr, tpr, threshold) for every distinct score, plus the origin with a null
    threshold (= above every score)."""
    keys = list(keys)
    pts = curve.select(
        *keys,
        F.when(F.col("N") > 0, F.col("fp") / F.col("N")).alias("fpr"),
        F.when(F.col("P") > 0, F.col("tp") / F.col("P")).alias("tpr"),
        F.col("score").alias("threshold"),
    )
    origin = _totals(curve, keys).select(
        *keys, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold")
    )
    return pts.unionByName(origin)


def pr_points(curve: DataFrame, keys=DEFAULT_KEYS, with_end: bool = True) -> DataFrame:
    """(precision, recall, threshold); the end point (1, 0, null) unless
    with_end=False (precision and recall by threshold)."""
    keys = list(keys)
    pts = curve.select(
        *keys,
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(1.0)).alias("recall"),
        F.col("score").alias("threshold"),
    )
    if not with_end:
        return pts
    end = _totals(curve, keys).select(
        *keys, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold")
    )
    return pts.unionByName(end)


def average_precision(curve: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """E11 + E12: step-wise AP = sum (R_i - R_{i-1}) P_i, random baseline, lift."""
    keys = list(keys)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    out = curve.groupBy(*keys).agg(
        F.sum(F.col("pos") * prec).alias("_s"), F.first("P").alias("P"), F.first("N").alias("N")
    )
    ap = F.when(F.col("P") > 0, F.col("_s") / F.col("P"))
    base = F.col("P") / (F.col("P") + F.col("N"))
    return out.select(*keys, ap.alias("average_precision"), base.alias("baseline"), (ap - base).alias("lift"))


def _metrics_at(tp: Column, fp: Column, P: Column, N: Column) -> dict[str, Column]:
    fn, tn = P - tp, N - fp
    return metric_columns(tn, fp, fn, tp)


def youden_threshold(curve: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """E13 + O6: threshold maximising tpr - fpr (first = highest threshold on ties, the
    origin first of all), with accuracy / precision / recall / F1 when predicting
    score >= threshold."""
    keys = list(keys)
    pts = curve.select(*keys, "score", "tp", "fp", "P", "N")
    origin = _totals(curve, keys).select(
        *keys, F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("fp"), "P", "N",
    )
    allp = pts.unionByName(origin).withColumns(
        {
            "fpr": F.when(F.col("N") > 0, F.col("fp") / F.col("N")),
            "tpr": F.when(F.col("P") > 0, F.col("tp") / F.col("P")),
            "_ord": F.coalesce(F.col("score"), F.lit(float("inf"))),
        }
    )
    best = allp.groupBy(*keys).agg(
        F.max_by(F.struct("score", "fpr", "tpr", "tp", "fp", "P", "N"), F.struct(F.col("tpr") - F.col("fpr"), "_ord")).alias("b")
    )
    b = {c: F.col(f"b.{c}") for c in ("score", "fpr", "tpr", "tp", "fp", "P", "N")}
    m = _metrics_at(b["tp"], b["fp"], b["P"], b["N"])
    return best.select(
        *keys,
        b["score"].alias("optimal_threshold"),
        b["fpr"].alias("fpr"),
        b["tpr"].alias("tpr"),
        m["accuracy"].alias("accuracy"),
        m["precision"].alias("precision"),
        m["recall"].alias("recall"),
        m["f1"].alias("f1_score"),
    )


def f1_threshold(curve: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """E14 + O6: threshold maximising F1 on the PR curve (first = lowest threshold on
    ties; the end point has F1 = 0 and no threshold, so it is left out, Q13)."""
    keys = list(keys)
    prec = F.col("tp") / (F.col("tp") + F.col("fp"))
    rec = F.when(F.col("P") > 0, F.col("tp") / F.col("P")).otherwise(F.lit(1.0))
    pts = curve.withColumns({"_p": prec, "_r": rec}).withColumn(
        "_f1",
        F.when(F.col("_p") + F.col("_r") > 0, F.lit(2.0) * (F.col("_p") * F.col("_r")) / (F.col("_p") + F.col("_r")))
        .otherwise(F.lit(0.0)),
    )
    best = pts.groupBy(*keys).agg(
        F.max_by(F.struct("score", "_p", "_r", "_f1", "tp", "fp", "P", "N"), F.struct(F.col("_f1"), -F.col("score"))).alias("b")
    )
    b = {c: F.col(f"b.{c}") for c in ("score", "_p", "_r", "_f1", "tp", "fp", "P", "N")}
    m = _metrics_at(b["tp"], b["fp"], b["P"], b["N"])
    return best.select(
        *keys,
        b["score"].alias("optimal_threshold"),
        b["_p"].alias("precision"),
        b["_r"].alias("recall"),
        b["_f1"].alias("f1_score"),
        m["accuracy"].alias("accuracy"),
        m["precision"].alias("precision_at_threshold"),
        m["recall"].alias("recall_at_threshold"),
        m["f1"].alias("f1_at_threshold"),
    )


def roc_band(auc: Column) -> Column:
    """AUC band."""
    return (
        F.when(auc >= 0.8, "Excellent").when(auc >= 0.7, "Good").when(auc >= 0.6, "Fair").otherwise("Poor")
    )


def pr_band(ap: Column, baseline: Column) -> Column:
    """Average-precision band, with "Better than Random" at baseline + 0.1."""
    return (
        F.when(ap >= 0.8, "Excellent")
        .when(ap >= 0.7, "Good")
        .when(ap >= 0.6, "Fair")
        .when(ap >= baseline + 0.1, "Better than Random")
        .otherwise("Poor")
    )


def performance_bands(curve: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    keys = list(keys)
    a = roc_auc(curve, keys).join(average_precision(curve, keys), keys)
    return a.select(
        *keys,
        "auc",
        roc_band(F.col("auc")).alias("roc_band"),
        "average_precision",
        "baseline",
        pr_band(F.col("average_precision"), F.col("baseline")).alias("pr_band"),
    )


# ------------------------------------------------------------------ comparisons


def fold_metrics(preds: DataFrame, keys=DEFAULT_KEYS) -> DataFrame:
    """Per (model, fold): accuracy, precision, recall, F1 and AUC (the reference's five)."""
    keys = list(keys)
    m = binary_metrics(confusion(preds, keys)).select(*keys, "accuracy", "precision", "recall", "specificity", "f1")
    return m.join(roc_auc(score_curve(preds, keys), keys), keys)


def metrics_long(metrics: DataFrame, model: str = "model") -> DataFrame:
    """Wide metrics -> (model, Metric, Score) for the five compared metrics."""
    return metrics.select(
        model,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("Metric"), F.col(c).cast("double").alias("Score"))
                    for name, c in zip(METRIC_NAMES, ["accuracy", "precision", "recall", "specificity", "f1"])
                ]
            )
        ),
    )


def model_comparison(metrics: DataFrame, model: str = "model") -> DataFrame:
    """E18 + A12: long metrics pivoted to one row per model, one column per metric."""
    long = metrics_long(metrics, model)
    return long.groupBy(model).pivot("Metric", METRIC_NAMES).agg(F.first("Score"))


def fold_comparison(metrics: DataFrame, metric: str, folds: list[str], model: str = "model") -> DataFrame:
    """Model x fold table of one metric; a missing fold stays null ("N/A")."""
    return metrics.groupBy(model).pivot("fold", folds).agg(F.first(metric))


def fold_metric_summary(metrics: DataFrame, model: str = "model") -> DataFrame:
    """A9 + A10 + O5: mean and population std over folds per model, best mean AUC first."""
    names = ["accuracy", "precision", "recall", "f1", "auc"]
    aggs = []
    for c in names:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return metrics.groupBy(model).agg(F.count(F.lit(1)).alias("folds"), *aggs).orderBy(F.desc("auc_mean"))
