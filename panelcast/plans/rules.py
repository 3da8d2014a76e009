"""Learner-free scores (FIXTURES C) so the evaluation operators can be checked by SQL.

Three single-indicator "models" score each panel row; scores are rounded to 3
decimals so tied scores stay tied in every engine.  prediction = score > 0.5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import stable_round


def rule_scores() -> dict[str, Column]:
    return {
        "rsi": stable_round(F.col("RSI") / 100, 3),
        "bb_position": stable_round(F.least(F.greatest(F.col("BB_Position"), F.lit(0.0)), F.lit(1.0)), 3),
        "price_position": stable_round(F.col("Price_Position_20"), 3),
    }


def rule_predictions(panel: DataFrame, fold: str | None = None) -> DataFrame:
    """predictions(model, fold, Ticker, Date, Target, prediction, probability).

    `fold` labels every row; when None the panel's own `fold` column is kept.
    """
    scores = rule_scores()
    fold_col = F.lit(fold) if fold is not None else F.col("fold")
    wide = panel.select(
        "Ticker", "Date", "Target", fold_col.cast("string").alias("fold"), *[v.alias(k) for k, v in scores.items()]
    )
    long = wide.unpivot(["Ticker", "Date", "Target", "fold"], list(scores), "model", "probability")
    return long.select(
        "model",
        "fold",
        "Ticker",
        "Date",
        "Target",
        (F.col("probability") > 0.5).cast("int").alias("prediction"),
        "probability",
    )


def fold_rule_predictions(panel: DataFrame, folds: DataFrame) -> DataFrame:
    """Rule predictions on each fold's validation window (fold label = fold number).

    `folds` has at most n_splits rows; a panel row plays in every fold whose window holds it.
    """
    windows = folds.select("fold", "val_start", "val_end").collect()
    if not windows:
        return rule_predictions(panel.limit(0), "")
    of = F.array(*[F.when(F.col("Date").between(r["val_start"], r["val_end"]), F.lit(r["fold"])) for r in windows])
    return rule_predictions(panel.withColumn("fold", F.explode(F.filter(of, lambda f: f.isNotNull()))))
