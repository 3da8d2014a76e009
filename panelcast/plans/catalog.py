"""Registered queries: each runs a library operator on the driver tables.

Every callable takes (spark, sf_dir) and returns a lazy DataFrame whose columns are
named and rounded exactly like the matching SQL in `plans.oracle_queries`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import stable_round
from ..operators import evaluate as ev
from ..operators.certificates import boosted_leaves, logistic_gradient
from ..operators.indices import index_features, join_index_features, wide_index_table
from ..operators.lags import lag_features
from ..operators.models import BOOSTED, FOREST, LOGISTIC, ModelSettings, class_weight_table, fit_models, fold_scaler_stats, prepare
from ..operators.series import LAYOUT_COLUMNS, as_series, layout_series
from ..operators.splits import (
    calendar_split_folds,
    equal_split_folds,
    final_test_frame,
    final_test_start,
    fold_frames,
    split_summary,
    trading_calendar,
    with_test_overlap,
)
from ..operators.summary import class_balance, panel_summary
from ..operators.technical import AUTOCORR_LAGS, technical_columns, technical_features, with_return_target
from ..operators.userfuncs import apply_to_slices, rolling_apply
from ..schema import LAG_FEATURES, TECHNICAL_FEATURES, output_digits
from ..session import checkpoint_dir, delete_folder, materialize
from ..sources.files import local_dates, read_bars, write_bars
from ..sources.tpch import REGION_ZONES, bars_from_lineitem, index_bars_from_orders, order_ticks
from .rules import fold_rule_predictions, rule_predictions
from .validation import date_filter, metrics_table, run_all, run_final, run_validation, score_saved, store_panel, summarize, union_all

KEYS = ["Ticker", "Date"]

# Column groups of the per-indicator queries (names are the reference's columns).
TECHNICAL_GROUPS = {
    "price_shape": ["Price_Range", "Price_Range_Pct", "Open_Close_Range", "High_Close_Range", "Low_Close_Range"],
    "volume_features": [
        "Volume_MA_5", "Volume_MA_10", "Volume_MA_20", "Volume_Ratio_5", "Volume_Ratio_10", "Volume_Ratio_20",
    ],
    "moving_averages": ["MA_5", "MA_10", "MA_20", "MA_50"],
    "ma_ratios": [
        "Price_MA5_Ratio", "Price_MA10_Ratio", "Price_MA20_Ratio", "Price_MA50_Ratio",
        "MA5_MA10", "MA10_MA20", "MA20_MA50",
    ],
    "volatility": ["Volatility_5", "Volatility_10", "Volatility_20"],
    "momentum": ["Momentum_5", "Momentum_10", "Momentum_20"],
    "rsi": ["RSI"],
    "bollinger": ["BB_Middle", "BB_Std", "BB_Upper", "BB_Lower", "BB_Width", "BB_Position"],
    "macd": ["MACD", "MACD_Signal", "MACD_Histogram"],
    "price_position": ["High_20", "Low_20", "Price_Position_20"],
    "return_moments": ["Return_MA_5", "Return_MA_10", "Return_MA_20", "Return_Skew_10", "Return_Kurt_10"],
    "autocorrelation": ["Autocorr_1", "Autocorr_2", "Autocorr_5"],
}


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column with the shared output policy."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: stable_round(c, output_digits(c)) for c in doubles}) if doubles else df


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in bars, derived once for each session and input: the layout counts
    them and the feature windows read them."""
    return materialize(bars_from_lineitem(spark, sf_dir), "bars", key="day")


def technical_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every indicator on every bar, before the last-row and undefined-row filters."""
    sf = technical_columns(with_return_target(layout_series(bars(spark, sf_dir))))
    return sf.finish()


def q_daily_bars(spark, sf_dir):
    return rounded(bars_from_lineitem(spark, sf_dir))


def q_bars_from_files(spark, sf_dir):
    """The stand-in bars written as one CSV file a ticker, and read back."""
    folder = f"{checkpoint_dir(spark)}/panelcast/bars-csv-{uuid.uuid4().hex}"
    write_bars(bars_from_lineitem(spark, sf_dir), folder)
    found, _ = read_bars(spark, folder)
    read = materialize(found, "bars-read")  # the result does not depend on the folder
    delete_folder(spark, folder)
    return rounded(read)


def q_log_return_target(spark, sf_dir):
    d = technical_all(spark, sf_dir).filter(~F.col("_is_last"))
    return rounded(d.select(*KEYS, "Return", "Target"))


def group_query(name: str):
    cols = TECHNICAL_GROUPS[name]

    def run(spark, sf_dir):
        return rounded(technical_all(spark, sf_dir).select(*KEYS, *cols))

    run.__name__ = f"q_{name}"
    run.__doc__ = f"Indicator group '{name}' on every bar: {', '.join(cols)}."
    return run


def rolling_autocorrelations(sf, prefix: str = "Autocorr_"):
    """V2: the 20-row autocorrelations of Return as user functions (T21 builds them in)."""

    def autocorr(k):
        def of(windows):
            import numpy as np

            x, y = windows[:, k:], windows[:, :-k]
            even = (x.max(1) == x.min(1)) | (y.max(1) == y.min(1))
            x, y = x - x.mean(1, keepdims=True), y - y.mean(1, keepdims=True)
            spread = np.sqrt((x * x).sum(1) * (y * y).sum(1))
            spread[even | (spread == 0)] = np.nan
            return np.clip((x * y).sum(1) / spread, -1.0, 1.0)

        return of

    return rolling_apply(sf, "Return", 20, {f"{prefix}{k}": autocorr(k) for k in AUTOCORR_LAGS})


def q_rolling_user_function(spark, sf_dir):
    sf = with_return_target(layout_series(bars(spark, sf_dir)))
    narrow = sf.with_df(sf.df.select(*KEYS, "Return", *LAYOUT_COLUMNS))
    return rounded(rolling_autocorrelations(narrow).finish().drop("Return"))


def q_ticker_user_function(spark, sf_dir):
    """V1: the fall from the highest of the last 22 closes, and since how many rows it lasts."""

    def drawdown(rows):
        import numpy as np

        close = rows["Close"]
        top = close.rolling(22, min_periods=1).max()
        at = np.arange(len(close), dtype=float)
        # The latest row at which the close of the moment was the highest of its 22.
        last = np.maximum.accumulate(np.where(close.to_numpy() == top.to_numpy(), at, -1.0))
        return {"Drawdown_22": close / top - 1, "Rows_Down": np.minimum(at - last, 22).astype("int64")}

    sf = as_series(bars(spark, sf_dir))
    narrow = sf.with_df(sf.df.select(*KEYS, "Close", *LAYOUT_COLUMNS))
    out = apply_to_slices(narrow, drawdown, ["Close"], {"Drawdown_22": "double", "Rows_Down": "long"}, look_back=44)
    return rounded(out.finish().drop("Close"))


def _changed_closes(spark, sf_dir, close) -> DataFrame:
    """Indicators of the stand-in bars with closes changed by their place in the ticker."""
    nth = F.row_number().over(Window.partitionBy("Ticker").orderBy("Date"))
    changed = bars(spark, sf_dir).withColumn("_nth", nth).withColumn("Close", close).drop("_nth")
    return technical_columns(with_return_target(layout_series(changed))).finish()


def q_return_moments_jump(spark, sf_dir):
    """Return moments where each ticker has one tick a hundred times too high."""
    close = F.when(F.col("_nth") == 100, F.col("Close") * 100).otherwise(F.col("Close"))
    return rounded(_changed_closes(spark, sf_dir, close).select(*KEYS, *TECHNICAL_GROUPS["return_moments"]))


def q_macd_gaps(spark, sf_dir):
    """MACD where every 97th close is missing."""
    close = F.when(F.col("_nth") % 97 != 0, F.col("Close"))
    return rounded(_changed_closes(spark, sf_dir, close).select(*KEYS, *TECHNICAL_GROUPS["macd"]))


def technical(spark: SparkSession, sf_dir: str):
    return technical_features(bars(spark, sf_dir))


def q_technical_panel(spark, sf_dir):
    d = technical(spark, sf_dir).finish()
    return rounded(d.select(*KEYS, "Target", "Return", *TECHNICAL_FEATURES))


def lagged(spark: SparkSession, sf_dir: str):
    return lag_features(technical(spark, sf_dir))


def q_lag_features(spark, sf_dir):
    d = lagged(spark, sf_dir).finish()
    return rounded(d.select(*KEYS, *LAG_FEATURES))


def q_lag_features_complete(spark, sf_dir):
    """P10: the lag features without the rows whose 5-row return lag is missing."""
    d = lag_features(technical(spark, sf_dir), drop_warmup=True).finish()
    return rounded(d.select(*KEYS, *LAG_FEATURES))


def index_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(index_features(index_bars_from_orders(spark, sf_dir)), "index-features", key="day")


def wide_index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per date, written once: its count and the join read the same files."""
    return materialize(wide_index_table(index_feature_rows(spark, sf_dir)), "index-wide", key="day")


def q_index_features(spark, sf_dir):
    return rounded(index_feature_rows(spark, sf_dir))


def q_index_local_days(spark, sf_dir):
    """X0 + F6: daily index bars by the wall-clock day of each index's own zone; the region
    without an entry in the zone table keeps days in UTC."""
    zones = spark.createDataFrame(list(REGION_ZONES.items()), "IndexName string, Zone string")
    ticks = order_ticks(spark, sf_dir).withColumn("_at", F.struct("Date", "Tick"))
    days = local_dates(ticks, zones).groupBy("IndexName", "Date")
    return rounded(days.agg(
        F.min_by("Price", "_at").alias("Open"),
        F.max("Price").alias("High"),
        F.min("Price").alias("Low"),
        F.max_by("Price", "_at").alias("Close"),
        F.count(F.lit(1)).cast("double").alias("Volume"),
    ))


def full(spark: SparkSession, sf_dir: str):
    """Technical -> lag -> index features, still in series layout."""
    return join_index_features(lagged(spark, sf_dir), wide_index_rows(spark, sf_dir))


def full_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full(spark, sf_dir).finish()


def q_index_join_ffill(spark, sf_dir):
    d = full_panel(spark, sf_dir)
    idx = [c for c in d.columns if c not in set(KEYS) and c not in set(LAG_FEATURES + TECHNICAL_FEATURES)
           and c not in ("Open", "High", "Low", "Close", "Volume", "Return", "Target")]
    return rounded(d.select(*KEYS, *idx))


def technical_rows(spark, sf_dir) -> DataFrame:
    return technical(spark, sf_dir).finish()


# Columns the split and rule-score queries read from the stored technical panel.
STORED_TECHNICAL_COLUMNS = ["Ticker", "Date", "Target", "Return", "RSI", "BB_Position", "Price_Position_20"]


def stored_technical(spark, sf_dir) -> DataFrame:
    """The technical panel (the columns those queries read) written once to the
    checkpoint folder, for queries that read it several times (calendar, fold table,
    final plan).  All 49 indicators are still computed: the row filter needs them."""
    rows = technical_rows(spark, sf_dir).select(*STORED_TECHNICAL_COLUMNS)
    return materialize(rows, "technical", key="narrow")


def q_panel_summary(spark, sf_dir):
    d = full_panel(spark, sf_dir)
    names = [r[0] for r in index_feature_rows(spark, sf_dir).select("IndexName").distinct().collect()]
    return rounded(panel_summary(d, names))


def q_class_balance(spark, sf_dir):
    return rounded(class_balance(technical_rows(spark, sf_dir)))


def q_trading_calendar(spark, sf_dir):
    """Every trading day of the bars with its place."""
    return trading_calendar(bars(spark, sf_dir))


def q_intraday_splits(spark, sf_dir):
    """K1 + K2 over timestamps: the folds and the test start of the ticks' distinct times."""
    ticks = materialize(order_ticks(spark, sf_dir), "order-ticks", key="all")
    folds, plan = equal_split_folds(ticks, n_splits=5, test_fraction=0.2)
    start = F.lit(final_test_start(ticks, 0.2)).cast("timestamp_ntz")
    times = folds.withColumn("test_start", start)
    names = ["train_end", "val_start", "val_end", "test_start"]
    return times.select("fold", *[F.col(n).cast("string").alias(n) for n in names], F.lit(plan.n_dates).cast("long").alias("n_times"))


def q_equal_splits(spark, sf_dir):
    panel = stored_technical(spark, sf_dir)
    folds, _ = equal_split_folds(panel, n_splits=5, test_fraction=0.2)
    return split_summary(panel, folds, min_val_rows=1000)


def q_folds_outside_test(spark, sf_dir):
    """S8 + Q5: every fold's two frames, the validation rows held out of the test period."""
    panel = stored_technical(spark, sf_dir)
    start = final_test_start(panel, 0.2)
    summary = with_test_overlap(split_summary(panel, equal_split_folds(panel, 5, 0.2)[0], 1000), start)
    folds = sorted(summary.collect(), key=lambda r: r["fold"])

    def sizes(row) -> DataFrame:
        train, val = fold_frames(panel, summary, row["fold"], exclude_test_from=start)
        both = train.withColumn("_side", F.lit(0)).unionByName(val.withColumn("_side", F.lit(1)))
        return both.agg(
            F.lit(row["fold"]).cast("long").alias("fold"),
            F.lit(row["overlaps_test"]).alias("overlaps_test"),
            F.count_if(F.col("_side") == 0).alias("train_rows"),
            F.count_if(F.col("_side") == 1).alias("val_rows"),
            F.max(F.when(F.col("_side") == 0, F.col("Date"))).alias("last_train"),
            F.max(F.when(F.col("_side") == 1, F.col("Date"))).alias("last_val"),
        )

    return union_all([sizes(row) for row in folds])


def q_calendar_splits(spark, sf_dir):
    panel = stored_technical(spark, sf_dir)
    folds = calendar_split_folds(panel, train_years=6, val_months=6, n_splits=5)
    return split_summary(panel, folds, min_val_rows=1000)


def q_final_test_split(spark, sf_dir):
    test = final_test_frame(stored_technical(spark, sf_dir), test_fraction=0.2)
    return test.agg(
        F.min("Date").alias("test_start"),
        F.max("Date").alias("test_end"),
        F.count(F.lit(1)).alias("test_samples"),
        F.countDistinct("Ticker").alias("test_stocks"),
        F.sum((F.col("Target") == 0).cast("long")).alias("test_down"),
        F.sum((F.col("Target") == 1).cast("long")).alias("test_up"),
    )


def q_calendar_splits_4y(spark, sf_dir):
    """K3 with a 4-year training start: the reference's 6 years leave no fold here."""
    panel = stored_technical(spark, sf_dir)
    folds = calendar_split_folds(panel, train_years=4, val_months=6, n_splits=5)
    return split_summary(panel, folds, min_val_rows=1000)


EVAL_KEYS = ["model", "fold"]


def test_predictions(spark, sf_dir) -> DataFrame:
    """Rule scores on the final test period of the technical panel."""
    return rule_predictions(final_test_frame(stored_technical(spark, sf_dir), 0.2), "test")


def validation_predictions(spark, sf_dir) -> DataFrame:
    """Rule scores on the validation window of every equal-size fold."""
    panel = stored_technical(spark, sf_dir)
    folds, _ = equal_split_folds(panel, 5, 0.2)
    return fold_rule_predictions(panel, split_summary(panel, folds, 1000))


def q_confusion_matrix(spark, sf_dir):
    return ev.confusion(test_predictions(spark, sf_dir), EVAL_KEYS)


def q_binary_metrics(spark, sf_dir):
    return rounded(ev.binary_metrics(ev.confusion(test_predictions(spark, sf_dir), EVAL_KEYS)))


def q_classification_report(spark, sf_dir):
    return rounded(ev.classification_report(ev.confusion(test_predictions(spark, sf_dir), EVAL_KEYS), EVAL_KEYS))


def q_confusion_breakdown(spark, sf_dir):
    return rounded(ev.confusion_breakdown(ev.confusion(test_predictions(spark, sf_dir), EVAL_KEYS), EVAL_KEYS))


def test_curve(spark, sf_dir) -> DataFrame:
    return ev.score_curve(test_predictions(spark, sf_dir), EVAL_KEYS)


def q_roc_curve(spark, sf_dir):
    return rounded(ev.roc_points(test_curve(spark, sf_dir), EVAL_KEYS))


def q_roc_auc(spark, sf_dir):
    return rounded(ev.roc_auc(test_curve(spark, sf_dir), EVAL_KEYS))


def q_pr_curve(spark, sf_dir):
    return rounded(ev.pr_points(test_curve(spark, sf_dir), EVAL_KEYS))


def q_pr_by_threshold(spark, sf_dir):
    return rounded(ev.pr_points(test_curve(spark, sf_dir), EVAL_KEYS, with_end=False))


def q_average_precision(spark, sf_dir):
    return rounded(ev.average_precision(test_curve(spark, sf_dir), EVAL_KEYS))


def q_performance_band(spark, sf_dir):
    return rounded(ev.performance_bands(test_curve(spark, sf_dir), EVAL_KEYS))


def q_youden_threshold(spark, sf_dir):
    return rounded(ev.youden_threshold(test_curve(spark, sf_dir), EVAL_KEYS))


def q_f1_threshold(spark, sf_dir):
    return rounded(ev.f1_threshold(test_curve(spark, sf_dir), EVAL_KEYS))


def q_model_comparison(spark, sf_dir):
    metrics = ev.fold_metrics(test_predictions(spark, sf_dir), EVAL_KEYS)
    return rounded(ev.model_comparison(metrics))


def q_fold_metric_summary(spark, sf_dir):
    metrics = ev.fold_metrics(validation_predictions(spark, sf_dir), EVAL_KEYS)
    return rounded(ev.fold_metric_summary(metrics))


def q_fold_accuracy_table(spark, sf_dir):
    metrics = ev.fold_metrics(validation_predictions(spark, sf_dir), EVAL_KEYS)
    return rounded(ev.fold_comparison(metrics, "accuracy", ["1", "2", "3", "4", "5"]))


def q_fold_auc_table(spark, sf_dir):
    metrics = ev.fold_metrics(validation_predictions(spark, sf_dir), EVAL_KEYS)
    return rounded(ev.fold_comparison(metrics, "auc", ["1", "2", "3", "4", "5"]))


# Tree ensembles of the registered queries: fewer and shallower trees than the library's
# defaults (the reference's values), whose fits take minutes a fold on one machine (README).
# Logistic regression, the folds and the rows are whole.
QUERY_MODELS = ModelSettings(rf_trees=20, rf_max_depth=6, gbt_iter=15, gbt_max_depth=4)


def stored_full(spark, sf_dir) -> DataFrame:
    return store_panel(full_panel(spark, sf_dir), "full", key="all")


def panel_rows(spark, sf_dir) -> DataFrame:
    """Key, date and target of every row of the full panel, written once, for what reads no feature:
    the fold table and the classes.  The planner leaves out the columns nobody reads."""
    return materialize(full_panel(spark, sf_dir).select(*KEYS, "Target"), "panel-rows", key="narrow")


def _folds(panel: DataFrame) -> DataFrame:
    return split_summary(panel, equal_split_folds(panel, 5, 0.2)[0], 1000)


def _fold_query(model_name: str):
    def run(spark, sf_dir):
        panel = stored_full(spark, sf_dir)
        return rounded(metrics_table(run_validation(panel, _folds(panel), QUERY_MODELS, [model_name], stored=True)))

    run.__doc__ = f"M8 + K4: {model_name} fitted on every fold's training rows, metrics on its validation rows."
    return run


def q_final_models(spark, sf_dir):
    """All learners on all folds and on the final test, in the summary table."""
    panel = stored_full(spark, sf_dir)
    summary = _folds(panel)
    # Both are read several times below; fitted models are not to be scored again.
    val, test = run_all(panel, summary, final_test_start(panel, 0.2), QUERY_MODELS)
    val, test = materialize(val, "validation-predictions"), materialize(test, "test-predictions")
    return rounded(summarize(metrics_table(val), metrics_table(test)))


def q_saved_model_roundtrip(spark, sf_dir):
    """S9 + S10 + M10 + M11 + E19: every fold's and the final model of logistic regression saved
    under the checkpoint folder, loaded back, and all scored in one reading of the test rows."""
    panel = stored_full(spark, sf_dir)
    summary = _folds(panel)
    model_dir = f"{checkpoint_dir(spark)}/panelcast/models-{uuid.uuid4().hex}"
    run_validation(panel, summary, models=[LOGISTIC], model_dir=model_dir, stored=True)
    start = final_test_start(panel, 0.2)
    test = date_filter(panel, lo=start) if start is not None else panel.limit(0)
    run_final(panel, summary, start, models=[LOGISTIC], model_dir=model_dir, stored=True)
    # Written before the models go: the result does not depend on their folder.
    names = [str(r["fold"]) for r in summary.collect()] + ["final"]
    preds = materialize(score_saved(model_dir, test, names, [LOGISTIC]), "saved-predictions")
    delete_folder(spark, model_dir)
    return rounded(metrics_table(preds))


def each_fold(panel: DataFrame, per_fold) -> DataFrame:
    """per_fold(training rows) of every equal-split fold, with the fold's number."""
    return union_all([
        per_fold(date_filter(panel, hi=r["train_end"])).withColumn("fold", F.lit(r["fold"]).cast("long"))
        for r in sorted(_folds(panel).collect(), key=lambda r: r["fold"])
    ])


def q_scaler_stats(spark, sf_dir):
    """M2: the statistics the scaler fits on every fold's training rows (cleaned features).

    The features are read once, straight from their windows: the panel is not written for it."""
    folds = _folds(panel_rows(spark, sf_dir)).collect()
    panel, features = prepare(full_panel(spark, sf_dir))
    stats = fold_scaler_stats(panel, features, {r["fold"]: r["train_end"] for r in folds})
    price_level = F.col("feature").isin([c for c in features if output_digits(c) == 4])
    return stats.select(
        "fold",
        "feature",
        *[F.when(price_level, stable_round(c, 4)).otherwise(stable_round(c, 6)).alias(c) for c in ("mean", "std_pop", "std_samp")],
        "n",
    )


def q_class_weights(spark, sf_dir):
    """M6: balanced class weights of every fold's training rows."""
    return rounded(each_fold(panel_rows(spark, sf_dir), class_weight_table))


# The reference's learner stops at this largest component of the gradient.
GRADIENT_BOUND = 1e-4


def q_logreg_certificate(spark, sf_dir):
    """M3 checked: on every fold, the gradient of the penalised loss at the fitted weights is zero
    up to the bound at which the reference's learner stops."""
    panel = stored_full(spark, sf_dir)
    found = each_fold(panel, lambda rows: logistic_gradient(fit_models(rows, QUERY_MODELS, [LOGISTIC], stored=True)[LOGISTIC], rows))
    return found.groupBy("fold", "n_rows", "n_up").agg(
        (F.count(F.lit(1)) - 1).alias("n_features"), (F.max(F.abs("gradient")) <= GRADIENT_BOUND).alias("optimal")
    )


def q_boosted_certificate(spark, sf_dir):
    """M5 checked: on every fold, each tree's leaves hold every training row once, and each leaf
    predicts the mean target of its rows."""
    panel = stored_full(spark, sf_dir)
    leaves = each_fold(panel, lambda rows: boosted_leaves(fit_models(rows, QUERY_MODELS, [BOOSTED], stored=True)[BOOSTED], rows))
    right = F.abs(F.col("prediction") - F.col("expected")) <= 1e-9
    trees = leaves.groupBy("fold", "tree").agg(
        F.sum("n").alias("n"), F.sum("n_up").alias("n_up"), F.every(right).alias("right"),
    )
    return trees.groupBy("fold").agg(
        F.count(F.lit(1)).alias("trees"),
        F.min("n").alias("least_rows"),
        F.max("n").alias("most_rows"),
        F.max("n_up").alias("n_up"),
        F.every("right").alias("leaves_right"),
    )


def registry() -> dict:
    out = {
        "daily_bars": q_daily_bars,
        "bars_from_files": q_bars_from_files,
        "log_return_target": q_log_return_target,
    }
    for name in TECHNICAL_GROUPS:
        out[name] = group_query(name)
    out["return_moments_jump"] = q_return_moments_jump
    out["macd_gaps"] = q_macd_gaps
    out["rolling_user_function"] = q_rolling_user_function
    out["ticker_user_function"] = q_ticker_user_function
    out["technical_panel"] = q_technical_panel
    out["lag_features"] = q_lag_features
    out["lag_features_complete"] = q_lag_features_complete
    out["index_features"] = q_index_features
    out["index_local_days"] = q_index_local_days
    out["trading_calendar"] = q_trading_calendar
    out["intraday_splits"] = q_intraday_splits
    out["index_join_ffill"] = q_index_join_ffill
    out["panel_summary"] = q_panel_summary
    out["class_balance"] = q_class_balance
    out["equal_splits"] = q_equal_splits
    out["folds_outside_test"] = q_folds_outside_test
    out["calendar_splits"] = q_calendar_splits
    out["final_test_split"] = q_final_test_split
    out["calendar_splits_4y"] = q_calendar_splits_4y
    out["confusion_matrix"] = q_confusion_matrix
    out["binary_metrics"] = q_binary_metrics
    out["classification_report"] = q_classification_report
    out["confusion_breakdown"] = q_confusion_breakdown
    out["roc_curve"] = q_roc_curve
    out["roc_auc"] = q_roc_auc
    out["pr_curve"] = q_pr_curve
    out["pr_by_threshold"] = q_pr_by_threshold
    out["average_precision"] = q_average_precision
    out["performance_band"] = q_performance_band
    out["youden_threshold"] = q_youden_threshold
    out["f1_threshold"] = q_f1_threshold
    out["model_comparison"] = q_model_comparison
    out["fold_metric_summary"] = q_fold_metric_summary
    out["fold_auc_table"] = q_fold_auc_table
    out["fold_accuracy_table"] = q_fold_accuracy_table
    out["scaler_stats"] = q_scaler_stats
    out["class_weights"] = q_class_weights
    out["logreg_certificate"] = q_logreg_certificate
    out["boosted_certificate"] = q_boosted_certificate
    out["logreg_fold"] = _fold_query(LOGISTIC)
    out["random_forest_fold"] = _fold_query(FOREST)
    out["gbt_fold"] = _fold_query(BOOSTED)
    out["final_models"] = q_final_models
    out["saved_model_roundtrip"] = q_saved_model_roundtrip
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_technical_panel(spark, sf_dir)
