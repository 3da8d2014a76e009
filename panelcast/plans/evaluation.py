"""Entry C: every evaluation table from one predictions DataFrame.

predictions -> confusion table (one aggregation) and score curve (one two-level
scan); all other tables are projections or small aggregations of those two.  Callers
that need several tables should persist or materialise `preds` first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import evaluate as ev


def evaluation_tables(preds: DataFrame, keys=("model", "fold")) -> dict[str, DataFrame]:
    keys = list(keys)
    conf = ev.confusion(preds, keys)
    curve = ev.score_curve(preds, keys)
    metrics = ev.binary_metrics(conf).join(ev.roc_auc(curve, keys), keys)
    return {
        "confusion": conf,
        "metrics": metrics,
        "classification_report": ev.classification_report(conf, keys),
        "confusion_breakdown": ev.confusion_breakdown(conf, keys),
        "roc_points": ev.roc_points(curve, keys),
        "pr_points": ev.pr_points(curve, keys),
        "average_precision": ev.average_precision(curve, keys),
        "performance_bands": ev.performance_bands(curve, keys),
        "roc_thresholds": ev.youden_threshold(curve, keys),
        "pr_thresholds": ev.f1_threshold(curve, keys),
    }
