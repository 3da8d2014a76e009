"""Hand-made bars, and expected indicator values computed from their definitions.

Every expected value is taken from an explicit slice of plain numpy arrays, one row at
a time: two-pass moments, weighted sums for exponential means.  A value whose window
is not full or holds a missing number is missing.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd

from panelcast.schema import BARS_SCHEMA

SF001 = "/root/testdata/sf0.001"


def make_bars(spark, series: dict[str, pd.DataFrame]):
    frames = []
    for t, df in series.items():
        d = df.copy()
        d.insert(0, "Ticker", t)
        frames.append(d)
    pdf = pd.concat(frames, ignore_index=True)
    rows = [
        tuple(None if isinstance(x, float) and np.isnan(x) else x for x in r)
        for r in pdf[["Ticker", "Date", "Open", "High", "Low", "Close", "Volume"]].itertuples(index=False)
    ]
    return spark.createDataFrame(rows, BARS_SCHEMA)


def random_walk(n: int, seed: int, start=dt.date(2020, 1, 1), step_days=1, daily=0.02) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, daily, n)))
    high = close * (1 + rng.uniform(0, 0.02, n))
    low = close * (1 - rng.uniform(0, 0.02, n))
    open_ = low + (high - low) * rng.uniform(0, 1, n)
    vol = rng.integers(1, 1000, n).astype(float)
    dates = [start + dt.timedelta(days=step_days * i) for i in range(n)]
    return pd.DataFrame({"Date": dates, "Open": open_, "High": high, "Low": low, "Close": close, "Volume": vol})


def over(values: np.ndarray, n: int, at: int, fn) -> float:
    """fn of the n values ending at row `at`; missing unless all n are there."""
    part = values[at - n + 1 : at + 1] if at >= n - 1 else np.array([np.nan])
    return np.nan if np.isnan(part).any() else fn(part)


def sample_std(x: np.ndarray) -> float:
    d = x - x.sum() / len(x)
    return np.sqrt((d * d).sum() / (len(x) - 1))


def skew_g1(x: np.ndarray) -> float:
    if np.all(x == x[0]):
        return 0.0
    n, d = len(x), x - x.mean()
    m2, m3 = (d**2).mean(), (d**3).mean()
    return np.nan if m2 <= 1e-14 else m3 / m2**1.5 * np.sqrt(n * (n - 1)) / (n - 2)


def kurt_g2(x: np.ndarray) -> float:
    if np.all(x == x[0]):
        return -3.0
    n, d = len(x), x - x.mean()
    m2, m4 = (d**2).mean(), (d**4).mean()
    return np.nan if m2 <= 1e-14 else ((n + 1) * (m4 / m2**2 - 3) + 6) * (n - 1) / ((n - 2) * (n - 3))


def lagged_correlation(k: int):
    def fn(x: np.ndarray) -> float:
        a, b = x[k:] - x[k:].mean(), x[:-k] - x[:-k].mean()
        size = np.sqrt((a * a).sum() * (b * b).sum())
        return (a * b).sum() / size if size > 0 else np.nan

    return fn


def exponential_mean(values: np.ndarray, span: float, at: int) -> float:
    """Weighted mean of all values up to row `at`, weight (1 - 2/(span+1)) ^ age, missing ones left out."""
    seen = values[: at + 1]
    weight = (1 - 2 / (span + 1)) ** np.arange(at, -1, -1.0)
    there = ~np.isnan(seen)
    return (seen[there] * weight[there]).sum() / weight[there].sum() if there.any() else np.nan


def expected_indicators(df: pd.DataFrame) -> pd.DataFrame:
    """Values of SURVEY 2.5.2 on every bar of one ticker (a selection), by definition."""
    d = df.sort_values("Date").reset_index(drop=True)
    close, high, low, volume = (d[c].to_numpy(float) for c in ("Close", "High", "Low", "Volume"))
    rows = range(len(d))
    ret = np.array([np.nan] + [np.log(close[i] / close[i - 1]) for i in rows[1:]])
    step = np.array([np.nan] + [close[i] - close[i - 1] for i in rows[1:]])
    gain = np.array([x if x > 0 else 0.0 for x in step])
    loss = np.array([-x if x < 0 else 0.0 for x in step])
    out = {"Date": d["Date"], "Return": ret}
    out["Target"] = [int(i + 1 < len(d) and ret[i + 1] > 0) for i in rows]
    each = lambda values, n, fn: [over(values, n, i, fn) for i in rows]
    for n in (5, 10, 20, 50):
        out[f"MA_{n}"] = each(close, n, np.mean)
    for n in (5, 10, 20):
        out[f"Volume_MA_{n}"] = each(volume, n, np.mean)
        out[f"Volatility_{n}"] = each(ret, n, sample_std)
        out[f"Momentum_{n}"] = [close[i] / close[i - n] - 1 if i >= n else np.nan for i in rows]
        out[f"Return_MA_{n}"] = each(ret, n, np.mean)
    up, down = (np.array(each(x, 14, np.mean)) for x in (gain, loss))
    with np.errstate(divide="ignore", invalid="ignore"):
        out["RSI"] = 100 - 100 / (1 + up / down)
    out["BB_Std"] = each(close, 20, sample_std)
    macd = np.array([exponential_mean(close, 12, i) - exponential_mean(close, 26, i) for i in rows])
    out["MACD"] = macd
    out["MACD_Signal"] = [exponential_mean(macd, 9, i) for i in rows]
    out["High_20"], out["Low_20"] = each(high, 20, np.max), each(low, 20, np.min)
    out["Price_Position_20"] = (close - out["Low_20"]) / (np.array(out["High_20"]) - out["Low_20"])
    out["Return_Skew_10"], out["Return_Kurt_10"] = each(ret, 10, skew_g1), each(ret, 10, kurt_g2)
    for k in (1, 2, 5):
        out[f"Autocorr_{k}"] = each(ret, 20, lagged_correlation(k))
    return pd.DataFrame(out)


def surviving(df: pd.DataFrame) -> pd.DataFrame:
    """Expected rows of the technical panel: neither the last bar nor one with anything missing."""
    bars = df.sort_values("Date").reset_index(drop=True)
    want = expected_indicators(df)
    there = ~(want.isna().any(axis=1) | bars.isna().any(axis=1))
    return want[there & (want.index < len(want) - 1)].reset_index(drop=True)
