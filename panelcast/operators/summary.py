"""Dataset summaries as one-row DataFrames (one aggregation pass each)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import feature_columns, index_columns, lag_columns


def feature_families(columns: list[str], index_names: list[str]) -> dict[str, int]:
    """Counts of all, technical, lag and index feature columns."""
    feats = feature_columns(columns)
    lags = lag_columns(feats)
    idx = index_columns(feats, index_names)
    return {
        "n_features": len(feats),
        "n_technical": len(feats) - len(lags) - len(idx),
        "n_lag": len(lags),
        "n_index": len(idx),
    }


def panel_summary(panel: DataFrame, index_names: list[str] | None = None, key: str = "Ticker") -> DataFrame:
    """Rows, exact distinct tickers, date range, rows per ticker, feature families,
    target classes and return mean / sample std, in one aggregation."""
    fam = feature_families(panel.columns, index_names or [])
    out = panel.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(key).alias("tickers"),
        F.min("Date").alias("date_min"),
        F.max("Date").alias("date_max"),
        F.sum((F.col("Target") == 0).cast("long")).alias("target_down"),
        F.sum((F.col("Target") == 1).cast("long")).alias("target_up"),
        F.avg("Return").alias("return_mean"),
        F.stddev_samp("Return").alias("return_std"),
    )
    out = out.withColumn("rows_per_ticker", F.try_divide(F.col("rows"), F.col("tickers")).cast("double"))
    return out.withColumns({k: F.lit(v).cast("long") for k, v in fam.items()})


def class_balance(df: DataFrame, target: str = "Target") -> DataFrame:
    """Class counts (zero classes kept), shares and the up/down ratio."""
    t = F.col(target)
    out = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum((t == 0).cast("long")), F.lit(0).cast("long")).alias("n_down"),
        F.coalesce(F.sum((t == 1).cast("long")), F.lit(0).cast("long")).alias("n_up"),
    )
    return out.withColumns(
        {
            "share_down": F.try_divide(F.col("n_down"), F.col("total")).cast("double"),
            "share_up": F.try_divide(F.col("n_up"), F.col("total")).cast("double"),
            "up_down_ratio": F.try_divide(F.col("n_up"), F.col("n_down")).cast("double"),
        }
    )


def target_value_counts(df: DataFrame, target: str = "Target") -> DataFrame:
    """A4: value counts, most frequent first."""
    return df.groupBy(target).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"))
