"""V1, V2: user functions over slices, against built-in windows and plain pandas."""

import numpy as np
import pandas as pd
import pytest

from helpers import make_bars, random_walk
from panelcast.operators.series import SeriesLayout, layout_series
from panelcast.operators.technical import technical_columns, with_return_target
from panelcast.operators.userfuncs import apply_to_slices, layout_for, rolling_apply
from panelcast.plans.catalog import rolling_autocorrelations

SMALL = SeriesLayout(segment_rows=2048, halo_rows=1024)


def ordered(df):
    return df.toPandas().sort_values(["Ticker", "Date"]).reset_index(drop=True)


def test_rolling_function_equals_the_built_in_on_split_series(spark):
    bars = make_bars(spark, {"hot": random_walk(5000, 21), "cold": random_walk(40, 22), "short": random_walk(5, 23)})
    builtin = ordered(technical_columns(with_return_target(layout_series(bars))).finish())
    for layout in (None, SMALL):
        sf = with_return_target(layout_series(bars, layout))
        assert sf.segmented == (layout is not None)
        narrow = sf.with_df(sf.df.select("Ticker", "Date", "Return", "_seg", "_pos", "_blk", "_halo"))
        got = ordered(rolling_autocorrelations(narrow, prefix="User_").finish())
        assert len(got) == len(builtin) == 5045
        for k in (1, 2, 5):
            a, b = got[f"User_{k}"].to_numpy(float), builtin[f"Autocorr_{k}"].to_numpy(float)
            assert np.isnan(a).sum() == np.isnan(b).sum()
            np.testing.assert_allclose(a, b, rtol=1e-7, atol=1e-9)


def test_missing_and_flat_windows(spark):
    df = random_walk(120, 24)
    df.loc[40, "Close"] = np.nan
    df.loc[80, "Close"] = np.inf
    got = ordered(rolling_apply(make_bars(spark, {"a": df}), "Close", 7, {"Top": lambda w: w.max(axis=1)}).finish())
    want = df["Close"].replace(np.inf, np.nan).rolling(7).max()
    np.testing.assert_allclose(got["Top"].to_numpy(float), want.to_numpy())
    undefined = rolling_apply(make_bars(spark, {"a": df}), "Close", 7, {"None": lambda w: np.full(len(w), np.nan)})
    assert undefined.finish().filter("`None` is not null").count() == 0


def test_function_over_slices_keeps_rows_and_types(spark):
    walks = {"hot": random_walk(5000, 25), "cold": random_walk(90, 26)}
    bars = make_bars(spark, walks)

    def drawdown(rows):
        top = rows["Close"].rolling(22, min_periods=1).max()
        return {"Drawdown": rows["Close"] / top - 1, "Highest": rows["Close"] == top}

    sf = layout_series(bars, SMALL)
    out = apply_to_slices(sf, drawdown, ["Close"], {"Drawdown": "double", "Highest": "boolean"}, look_back=21)
    assert out.finish().schema.fields[: len(bars.columns)] == bars.schema.fields
    got = ordered(out.finish())
    for t, df in walks.items():
        own = got[got.Ticker == t]
        top = df["Close"].rolling(22, min_periods=1).max().to_numpy()
        np.testing.assert_allclose(own["Drawdown"].to_numpy(), df["Close"].to_numpy() / top - 1, atol=1e-12)
        assert (own["Highest"].to_numpy() == (df["Close"].to_numpy() == top)).all()
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_no_further_exchange_after_windows(spark):
    sf = with_return_target(layout_series(make_bars(spark, {"a": random_walk(60, 27)})))
    out = rolling_apply(sf, "Return", 5, {"M": lambda w: w.mean(axis=1)})
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_limits_and_empty_input(spark):
    bars = make_bars(spark, {"a": random_walk(5000, 28)})
    assert layout_for(3000, SMALL) == SeriesLayout(segment_rows=8192, halo_rows=4096)
    with pytest.raises(ValueError, match="halo"):
        rolling_apply(layout_series(bars, SMALL), "Close", 3000, {"M": lambda w: w.mean(axis=1)})
    with pytest.raises(ValueError, match="exist"):
        rolling_apply(bars, "Close", 3, {"Close": lambda w: w.mean(axis=1)})
    with pytest.raises(ValueError):
        rolling_apply(bars, "Close", 0, {})
    assert rolling_apply(bars.limit(0), "Close", 3, {"M": lambda w: w.mean(axis=1)}).finish().collect() == []
    # A window beyond the default halo on a series that is split by a layout made for it.
    long = ordered(rolling_apply(layout_series(bars.filter("Volume is not null"), layout_for(1500, SMALL)), "Close", 1500, {"M": lambda w: w.mean(axis=1)}).finish())
    want = pd.Series(ordered(bars)["Close"]).rolling(1500).mean()
    np.testing.assert_allclose(long["M"].to_numpy(float), want.to_numpy(), rtol=1e-9)
