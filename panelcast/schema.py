"""Schemas, metadata columns and feature families of the panel.

A panel is a long DataFrame keyed by (Ticker, Date).  Features are identified by
name: every column that is not in META_COLUMNS is a model input.
"""

from __future__ import annotations

import re

from pyspark.sql import types as T

BARS_SCHEMA = T.StructType(
    [
        T.StructField("Ticker", T.StringType(), False),
        T.StructField("Date", T.DateType(), False),
        T.StructField("Open", T.DoubleType(), True),
        T.StructField("High", T.DoubleType(), True),
        T.StructField("Low", T.DoubleType(), True),
        T.StructField("Close", T.DoubleType(), True),
        T.StructField("Volume", T.DoubleType(), True),
    ]
)

# Schema of one per-ticker CSV file (the ticker comes from the file name).
BAR_FILE_SCHEMA = T.StructType([f for f in BARS_SCHEMA.fields if f.name != "Ticker"])

INDEX_BARS_SCHEMA = T.StructType(
    [
        T.StructField("IndexName", T.StringType(), False),
        T.StructField("Date", T.DateType(), False),
        T.StructField("Open", T.DoubleType(), True),
        T.StructField("High", T.DoubleType(), True),
        T.StructField("Low", T.DoubleType(), True),
        T.StructField("Close", T.DoubleType(), True),
        T.StructField("Volume", T.DoubleType(), True),
    ]
)

# Columns that are never features (same list as the reference).
META_COLUMNS = ["Ticker", "Date", "Open", "High", "Low", "Close", "Volume", "Return", "Target"]

# The reference's seven market indices (display name -> quote symbol).
REFERENCE_INDICES = {
    "Nikkei_225": "^N225",
    "Hang_Seng": "^HSI",
    "All_Ordinaries": "^AORD",
    "DAX": "^GDAXI",
    "FTSE_100": "^FTSE",
    "NYSE_Composite": "^NYA",
    "DJIA": "^DJI",
}

# The 49 technical feature columns, in the reference's order.
TECHNICAL_FEATURES = [
    "Price_Range", "Price_Range_Pct", "Open_Close_Range", "High_Close_Range", "Low_Close_Range",
    "Volume_MA_5", "Volume_MA_10", "Volume_MA_20",
    "Volume_Ratio_5", "Volume_Ratio_10", "Volume_Ratio_20",
    "MA_5", "MA_10", "MA_20", "MA_50",
    "Price_MA5_Ratio", "Price_MA10_Ratio", "Price_MA20_Ratio", "Price_MA50_Ratio",
    "MA5_MA10", "MA10_MA20", "MA20_MA50",
    "Volatility_5", "Volatility_10", "Volatility_20",
    "Momentum_5", "Momentum_10", "Momentum_20",
    "RSI",
    "BB_Middle", "BB_Std", "BB_Upper", "BB_Lower", "BB_Width", "BB_Position",
    "MACD", "MACD_Signal", "MACD_Histogram",
    "High_20", "Low_20", "Price_Position_20",
    "Return_MA_5", "Return_MA_10", "Return_MA_20",
    "Return_Skew_10", "Return_Kurt_10",
    "Autocorr_1", "Autocorr_2", "Autocorr_5",
]

# The 21 lag feature columns, in the reference's order.
LAG_FEATURES = [
    "Lag_Return_1", "Lag_Return_2", "Lag_Return_3", "Lag_Return_4", "Lag_Return_5",
    "Lag_Return_10", "Lag_Return_15", "Lag_Return_20", "Lag_Return_22",
    "Lag_Return_Mean_5", "Lag_Return_Mean_22", "Lag_Return_Std_5", "Lag_Return_Std_22",
    "Lag_Price_MA5_Ratio_1", "Lag_Price_MA5_Ratio_5",
    "Lag_Price_MA20_Ratio_1", "Lag_Price_MA20_Ratio_5",
    "Lag_Volume_Ratio_5_1", "Lag_Volume_Ratio_5_5",
    "Lag_Volatility_5_1", "Lag_Volatility_20_1",
]

# The six columns kept per market index, as suffixes of "<name>_".
INDEX_FEATURE_SUFFIXES = ["Close", "Return", "MA_5", "MA_20", "Volatility_20", "Price_MA20_Ratio"]


# Columns added for storage (Parquet partitioning), never model inputs.
STORAGE_COLUMNS = ["year"]


def feature_columns(columns: list[str]) -> list[str]:
    """Every column that is not metadata (nor a storage / layout column), in order."""
    meta = set(META_COLUMNS) | set(STORAGE_COLUMNS)
    return [c for c in columns if c not in meta and not c.startswith("_")]


def lag_columns(columns: list[str]) -> list[str]:
    """The lag family, recognised by prefix."""
    return [c for c in columns if c.startswith("Lag_")]


def index_columns(columns: list[str], index_names: list[str]) -> list[str]:
    """The index family, recognised by substring of an index name."""
    return [c for c in columns if any(name in c for name in index_names)]


def safe_name(name: str) -> str:
    """Column-safe form of an index name ("MIDDLE EAST" -> "MIDDLE_EAST")."""
    out = "".join(ch if ch.isalnum() else "_" for ch in name.strip())
    return out or "_"


# Decimals of outputs that queries round: price-level columns keep four, others six.
PRICE_LEVEL = {
    "Open", "High", "Low", "Close", "Volume", "Price_Range",
    "Volume_MA_5", "Volume_MA_10", "Volume_MA_20", "MA_5", "MA_10", "MA_20", "MA_50",
    "BB_Middle", "BB_Std", "BB_Upper", "BB_Lower", "High_20", "Low_20",
    "MACD", "MACD_Signal", "MACD_Histogram",
}


def output_digits(name: str) -> int:
    if name in PRICE_LEVEL or name.endswith("_Close") or re.fullmatch(r"[A-Z_]+_MA_(5|20)", name):
        return 4
    return 6
