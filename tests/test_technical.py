import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import make_bars, random_walk, sample_std, surviving
from panelcast.operators.lags import lag_features
from panelcast.operators.series import SeriesLayout
from panelcast.operators.technical import technical_features, technical_panel
from panelcast.schema import LAG_FEATURES, TECHNICAL_FEATURES

CHECKED = [
    "Return", "MA_5", "MA_50", "Volume_MA_20", "Volatility_20", "Momentum_10", "Return_MA_20", "RSI",
    "BB_Std", "MACD", "MACD_Signal", "High_20", "Low_20", "Price_Position_20",
    "Return_Skew_10", "Return_Kurt_10", "Autocorr_1", "Autocorr_2", "Autocorr_5",
]


@pytest.fixture(scope="module")
def walks():
    return {"A": random_walk(300, 1), "B": random_walk(180, 2), "C": random_walk(75, 3)}


def test_multi_block_series_match_the_definitions(spark):
    """A 2,600-row series exceeds one EWM block: block sums + carries and the
    (_blk, Date) ordering are used; values still equal the definitions."""
    walks = {"L": random_walk(2600, 41), "S": random_walk(120, 42)}
    tech = technical_features(make_bars(spark, walks))
    assert not tech.single_block
    got = tech.finish().toPandas()
    for t, df in walks.items():
        want = surviving(df)
        g = got[got.Ticker == t].sort_values("Date").reset_index(drop=True)
        assert len(g) == len(want)
        for c in CHECKED:
            np.testing.assert_allclose(g[c].to_numpy(), want[c].to_numpy(), rtol=1e-9, atol=1e-9, err_msg=c)


def test_indicators_match_the_definitions(spark, walks):
    got = technical_panel(make_bars(spark, walks)).toPandas()
    for t, df in walks.items():
        want = surviving(df)
        g = got[got.Ticker == t].sort_values("Date").reset_index(drop=True)
        assert len(g) == len(want), t
        for c in CHECKED:
            np.testing.assert_allclose(g[c].to_numpy(), want[c].to_numpy(), rtol=1e-9, atol=1e-9, err_msg=c)
        assert (g["Target"].to_numpy() == want["Target"].to_numpy()).all()


def test_warmup_drops_first_49_rows_and_last_row(spark, walks):
    got = technical_panel(make_bars(spark, walks))
    counts = {r[0]: r[1] for r in got.groupBy("Ticker").count().collect()}
    assert counts == {"A": 300 - 50, "B": 180 - 50, "C": 75 - 50}


def test_short_tickers_give_no_rows(spark):
    bars = make_bars(spark, {"one": random_walk(1, 4), "short": random_walk(49, 5), "ok": random_walk(51, 6)})
    counts = {r[0]: r[1] for r in technical_panel(bars).groupBy("Ticker").count().collect()}
    assert counts == {"ok": 1}


def test_constant_close_rows_are_dropped_without_error(spark):
    df = random_walk(120, 7)
    df.loc[40:100, ["Open", "High", "Low", "Close"]] = 50.0
    got = technical_panel(make_bars(spark, {"flat": df})).toPandas()
    flat_days = set(df.loc[60:100, "Date"])
    assert not flat_days & set(got["Date"])  # RSI, BB_Position, autocorr undefined there


def test_zero_volume_rows_are_dropped(spark):
    df = random_walk(120, 8)
    df.loc[60:85, "Volume"] = 0.0
    got = technical_panel(make_bars(spark, {"z": df})).toPandas()
    assert not set(df.loc[64:85, "Date"]) & set(got["Date"])


def test_strictly_rising_close_gives_rsi_100(spark):
    df = random_walk(80, 9)
    df["Close"] = 10.0 + np.arange(80) * 0.5 + np.random.default_rng(1).uniform(0, 0.1, 80)
    df["Close"] = np.maximum.accumulate(df["Close"]) + np.arange(80) * 1e-3
    df["High"], df["Low"], df["Open"] = df["Close"] + 1, df["Close"] - 1, df["Close"]
    got = technical_panel(make_bars(spark, {"up": df})).toPandas()
    assert len(got) > 0 and (got["RSI"] == 100.0).all()


def test_segmented_layout_matches_single_segment(spark):
    """A ticker split into 2,048-row segments (1,024-row halo) gives the same panel."""
    walks = {"hot": random_walk(5000, 11), "cold": random_walk(90, 12)}
    bars = make_bars(spark, walks)
    small = SeriesLayout(segment_rows=2048, halo_rows=1024)
    a = lag_features(technical_features(bars)).finish().toPandas().sort_values(["Ticker", "Date"]).reset_index(drop=True)
    sf = technical_features(bars, small)
    assert sf.segmented
    b = lag_features(sf).finish().toPandas().sort_values(["Ticker", "Date"]).reset_index(drop=True)
    assert len(a) == len(b)
    for c in ["Return", "Target"] + TECHNICAL_FEATURES + LAG_FEATURES:
        np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_no_leakage_future_rows_do_not_change_features(spark):
    df = random_walk(200, 13)
    base = technical_panel(make_bars(spark, {"x": df})).toPandas()
    changed = df.copy()
    changed.loc[150:, ["Open", "High", "Low", "Close"]] *= 3.0
    after = technical_panel(make_bars(spark, {"x": changed})).toPandas()
    cut = df.loc[148, "Date"]  # the target at 149 looks at row 150
    a = base[base.Date <= cut].sort_values("Date")
    b = after[after.Date <= cut].sort_values("Date")
    for c in TECHNICAL_FEATURES:
        np.testing.assert_allclose(a[c].to_numpy(), b[c].to_numpy(), rtol=1e-12, err_msg=c)


def expected_lags(tech: pd.DataFrame) -> pd.DataFrame:
    """SURVEY 2.5.3 by position in one ticker's surviving rows: what stands k rows earlier,
    and statistics of the n returns before today; 0 where there are not so many rows."""
    rows = tech.sort_values("Date").reset_index(drop=True)
    ret = rows["Return"].to_numpy(float)
    out = {}

    def earlier(source: str, k: int) -> list:
        values = rows[source].to_numpy(float)
        return [values[i - k] if i >= k else 0.0 for i in range(len(rows))]

    def before(n: int, fn) -> list:
        return [fn(ret[i - n : i]) if i >= n else 0.0 for i in range(len(rows))]

    for name in LAG_FEATURES:
        *source, last = name.removeprefix("Lag_").split("_")
        if source[-1] in ("Mean", "Std"):
            out[name] = before(int(last), np.mean if source[-1] == "Mean" else sample_std)
        else:
            out[name] = earlier("_".join(source), int(last))
    return pd.DataFrame(out).replace([np.inf, -np.inf], 0.0)


def test_lag_features_match_the_definitions(spark, walks):
    tech = technical_features(make_bars(spark, walks))
    got = lag_features(tech).finish().toPandas()
    base = tech.finish().toPandas()
    for t in walks:
        want = expected_lags(base[base.Ticker == t])
        g = got[got.Ticker == t].sort_values("Date").reset_index(drop=True)
        assert len(g) == len(want)
        for c in LAG_FEATURES:
            np.testing.assert_allclose(g[c].to_numpy(), want[c].to_numpy(), rtol=1e-9, atol=1e-12, err_msg=c)


def test_moments_after_a_jump(spark):
    """One 100-fold tick at 0.05 % volatility: rows past its windows are exact, split or not."""
    df = random_walk(300, 51, daily=0.0005)
    df.loc[100, ["Open", "High", "Low", "Close"]] *= 100.0
    long = random_walk(4200, 52, daily=0.0005)
    long.loc[2040, ["Open", "High", "Low", "Close"]] *= 100.0
    for walks, layout in (({"J": df}, None), ({"K": long}, SeriesLayout(segment_rows=2048, halo_rows=1024))):
        got = technical_features(make_bars(spark, walks), layout).finish().toPandas().sort_values("Date").reset_index(drop=True)
        want = surviving(next(iter(walks.values())))
        assert len(got) == len(want)
        for c in ("Return_Skew_10", "Return_Kurt_10", "Autocorr_1", "Autocorr_2", "Autocorr_5"):
            np.testing.assert_allclose(got[c], want[c], rtol=1e-8, atol=1e-9, err_msg=c)


def test_missing_closes(spark):
    """Gaps at the start, in the middle and at a block boundary; only their windows are lost."""
    short, long = random_walk(200, 61), random_walk(2600, 62)
    short.loc[[0, 1, 150], "Close"] = np.nan
    long.loc[[0, 700, 1023, 1024, 2047, 2048], "Close"] = np.nan
    for name, df in (("s", short), ("l", long)):
        got = technical_panel(make_bars(spark, {name: df})).toPandas().sort_values("Date").reset_index(drop=True)
        want = surviving(df)
        assert len(got) == len(want) > 0
        for c in ("MACD", "MACD_Signal", "MA_50", "Return_Kurt_10", "RSI"):
            np.testing.assert_allclose(got[c], want[c], rtol=1e-9, atol=1e-9, err_msg=c)


def test_lags_over_segments_without_survivors(spark):
    """A price that stays constant for two whole segments: the 22 rows before lie far back."""
    df = random_walk(9000, 31)
    df.loc[1000:2150, ["Open", "High", "Low", "Close"]] = 80.0  # no survivors in segment 1's halo
    df.loc[3000:7500, ["Open", "High", "Low", "Close"]] = 90.0  # none at all in segment 2
    df.loc[8185:8189, ["Open", "High", "Low", "Close"]] = 95.0
    bars = make_bars(spark, {"hot": df, "cold": random_walk(120, 32)})
    layout = SeriesLayout(segment_rows=2048, halo_rows=1024)
    split = technical_features(bars, layout)
    assert split.segmented
    order = lambda d: d.toPandas().sort_values(["Ticker", "Date"]).reset_index(drop=True)
    a, b = order(lag_features(technical_features(bars)).finish()), order(lag_features(split).finish())
    assert len(a) == len(b) and list(a.columns) == list(b.columns)
    for c in ["Date", *LAG_FEATURES]:
        np.testing.assert_array_equal(a[c].to_numpy(), b[c].to_numpy(), err_msg=c)
    w, x = order(lag_features(technical_features(bars), drop_warmup=True).finish()), order(lag_features(split, drop_warmup=True).finish())
    assert len(w) == len(x) == len(a) - 10
