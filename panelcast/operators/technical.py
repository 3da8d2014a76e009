"""Log return, next-day target and the 49 technical indicators.

One hash exchange on (Ticker, _seg) serves every window below: row numbers, leads and ten
closes -> EWM 12 + 26 block sums with the lags of MA_50 and the lagged values, over which every
statistic of up to 20 rows is a plain expression -> EWM 9 block sums; on series longer than one
block the carries add a level each.
Stage order follows the reference: features are computed on all rows, the last row of
each series is dropped (no next-day target), then any row with an undefined value is
dropped, then +-inf is set to 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataclasses import replace

from pyspark.sql import Window

from ..functions.ewm import with_ewm, with_ewms
from ..functions.expr import centre_of, clean, extreme_of, given_back, held_aside, lagged, leading, mean_of, safe_div, squares_about, total
from ..schema import TECHNICAL_FEATURES
from .series import LAYOUT_COLUMNS, SeriesFrame, SeriesLayout, as_series


def log_return(close: str = "Close", prev: str = "_prev_close"):
    """ln(Close_t / Close_{t-1}) as floating-point arithmetic has it: a ratio of zero gives
    -inf, of infinity +inf (a zero previous price), a negative or undefined one is missing."""
    ratio = safe_div(close, prev)
    return F.when(ratio > 0, F.log(ratio)).when(ratio == 0, F.lit(float("-inf")))


CLOSE_LAGS = 20  # the deepest earlier close: the return of 19 rows ago begins there


def lags_of(name: str, n: int) -> list:
    """The row's own value and those of the n - 1 rows before it (columns of `lagged`)."""
    return [F.col(name), *[F.col(f"_{name}_{k}") for k in range(1, n)]]


def with_return_target(sf: SeriesFrame) -> SeriesFrame:
    """T0, T1, P7 plus the helpers later levels need (_pos, _blk, _is_last, _sum_10: the sum of
    ten closes).

    Row numbering, lags and leads share one window level ordered by time.  Unused ones are
    pruned by the planner.
    """
    lay = sf.layout
    w0 = Window.partitionBy(lay.key, "_seg").orderBy(lay.order)
    first = {
        "_next_close": F.lead("Close").over(w0),
        "_is_last": F.lead(lay.order).over(w0).isNull(),
        **lagged("Close", 9, w0),
    }
    if not sf.positioned:
        first["_pos"] = F.coalesce(F.col("_pos"), (F.row_number().over(w0) - 1).cast("long"))
    d = sf.df.withColumns(first)
    if not sf.positioned:
        d = d.withColumn("_blk", sf.block_id())
    d = d.withColumns(
        {
            "_prev_close": F.col("_Close_1"),
            "Return": log_return("Close", "_Close_1"),
            # NaN > 0 is false in the reference, so a missing next return gives 0.
            "Target": F.coalesce((log_return("_next_close", "Close") > 0).cast("int"), F.lit(0)),
            "_sum_10": total(lags_of("Close", 10)),
        }
    ).drop(*[f"_Close_{k}" for k in range(1, 10)])
    return replace(sf, df=d, positioned=True)


AUTOCORR_LAGS = (1, 2, 5)


def with_moments(d: DataFrame) -> DataFrame:
    """T20 (W6, W7) and T21 (W8) as statistics of bounded frames: a row's value depends on
    its own 10 or 20 returns (_r_0 to _r_19, _finite the number there and finite) only,
    whatever came before.

    Skew and kurtosis over 10 returns: identical values give 0 / -3, a variance at or below
    1e-14 gives nothing, otherwise the bias-corrected G1 / G2.  Autocorr_k is the
    Pearson correlation of the 20 - k pairs (r_i, r_{i-k}) inside the 20-row window,
    undefined when either side is flat.  Infinite returns leave all of them undefined.
    """
    r, n = filled("r", 20), 10
    flat = lambda values: reduce(lambda a, b: a & b, [v == values[0] for v in values[1:]])
    sides = {k: (r[: 20 - k], r[k:]) for k in AUTOCORR_LAGS}
    d = d.withColumns(
        {
            "_flat_10": flat(r[:n]),
            "_mid_10": centre_of(r[:n]),
            **{f"_even_{k}": flat(x) | flat(y) for k, (x, y) in sides.items()},
            **{f"_mid_x{k}": centre_of(x) for k, (x, _) in sides.items()},
            **{f"_mid_y{k}": centre_of(y) for k, (_, y) in sides.items()},
        }
    )
    e = [v - F.col("_mid_10") for v in r[:n]]
    sums = {"_m2": total([x * x for x in e]), "_m3": total([x * x * x for x in e]), "_m4": total([x * x * x * x for x in e])}
    for k, (x, y) in sides.items():
        mx, my = F.col(f"_mid_x{k}"), F.col(f"_mid_y{k}")
        sums[f"_xx{k}"], sums[f"_yy{k}"] = squares_about(x, mx), squares_about(y, my)
        sums[f"_xy{k}"] = total([(a - mx) * (b - my) for a, b in zip(x, y)])
    d = d.withColumns(sums)
    full, is_flat, m2 = F.col("_finite") >= n, F.col("_flat_10"), F.col("_m2")
    spread = full & ~is_flat & (m2 / n > 1e-14)
    g1 = n**0.5 * F.col("_m3") / F.sqrt(m2 * m2 * m2) * ((n * (n - 1)) ** 0.5 / (n - 2))
    g2 = ((n + 1) * (n * F.col("_m4") / (m2 * m2) - 3) + 6) * ((n - 1) / ((n - 2) * (n - 3)))
    out = {
        "Return_Skew_10": F.when(full & is_flat, F.lit(0.0)).when(spread, g1),
        "Return_Kurt_10": F.when(full & is_flat, F.lit(-3.0)).when(spread, g2),
    }
    for k in AUTOCORR_LAGS:
        xx, yy = F.col(f"_xx{k}") / (20 - k), F.col(f"_yy{k}") / (20 - k)
        c = safe_div(F.col(f"_xy{k}") / (20 - k), F.sqrt(xx * yy))
        some = (F.col("_finite") >= 20) & ~F.col(f"_even_{k}") & (xx > 0) & (yy > 0)
        out[f"Autocorr_{k}"] = F.when(some, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))
    return d.withColumns(out)


MOMENT_SUMS = ["_flat_10", "_m2", "_m3", "_m4"] + [f"{c}{k}" for c in ("_even_", "_xx", "_yy", "_xy") for k in AUTOCORR_LAGS]


AFTER_EWM_9 = ["MACD_Signal", "MACD_Histogram"]


def present(df: DataFrame, name: str):
    """Neither missing nor NaN, as DataFrame.na.drop has it."""
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else c.isNotNull()


def filled(name: str, n: int) -> list:
    """The n columns _<name>_<k> that hold a value in every row (see `fill`)."""
    return [F.col(f"_{name}_{k}") for k in range(n)]


def fill(name: str, values: list) -> dict:
    """Columns _<name>_<k>: the `values` with 0 in place of a missing one.  Sums over them need no
    look for missing values, which costs more than the sums; a count of the values there
    (`leading`) says for the whole statistic whether it is defined."""
    return {f"_{name}_{k}": F.coalesce(v, F.lit(0.0)) for k, v in enumerate(values)}


def technical_columns(sf: SeriesFrame) -> SeriesFrame:
    """Add the 49 indicator columns (rows not yet filtered).

    The lagged values share the window level of the EWM 12 / 26 block sums and the places of
    MA_50 (10-row sums), which reads narrow rows.  Statistics of up to 20 rows are
    expressions over them: a frame of n rows is not gone through again for every row.  The
    earlier returns ln(C_{t-k} / C_{t-k-1}) are projections of lagged closes, bit-identical to
    lag(Return, k).  The level of EWM 9 copies what it does not need in one piece.
    """
    w = sf.window()
    key = sf.layout.key
    close, high, low, vol = (F.col(c) for c in ("Close", "High", "Low", "Volume"))
    part = [key, "_seg"]
    order, shared = sf.layout.order, sf.ewm_block()
    m = None if sf.segmented else sf.max_rows
    fifty = {"MA_50": total([F.col("_sum_10"), *[F.lag("_sum_10", k).over(w) for k in (10, 20, 30, 40)]]) / 50}
    before = {
        # A row 13 rows back exists: 14 gains and losses, which are 0 at a missing close.
        "_has_14": F.lag(F.lit(True), 13).over(w),
        **lagged("Close", CLOSE_LAGS, w),
        **{name: v for c in ("High", "Low", "Volume") for name, v in lagged(c, 19, w).items()},
    }
    d = with_ewms(
        sf.df, [("Close", 12, "_ema12"), ("Close", 26, "_ema26")], part, order, "_pos", shared, m, alongside=fifty | before
    ).drop("_sum_10")
    closes, highs, lows, volumes = (lags_of(c, 20) for c in ("Close", "High", "Low", "Volume"))
    delta = [a - b for a, b in zip(closes[:14], [*closes[1:14], F.col("_Close_14")])]
    fourteen = F.col("_has_14").isNotNull()
    d = d.withColumns(
        {
            "MACD": F.col("_ema12") - F.col("_ema26"),
            "Price_Range": high - low,
            "Price_Range_Pct": safe_div(high - low, close),
            "Open_Close_Range": safe_div(F.abs(F.col("Open") - close), close),
            "High_Close_Range": safe_div(high - close, close),
            "Low_Close_Range": safe_div(close - low, close),
            **{f"Volume_MA_{n}": mean_of(volumes[:n]) for n in (5, 10, 20)},
            **{f"Momentum_{n}": safe_div(close, F.col(f"_Close_{n}")) - 1 for n in (5, 10, 20)},
            "_avg_gain": F.when(fourteen, mean_of([F.when(x > 0, x).otherwise(F.lit(0.0)) for x in delta])),
            "_avg_loss": F.when(fourteen, mean_of([F.when(x < 0, -x).otherwise(F.lit(0.0)) for x in delta])),
            "High_20": extreme_of(F.greatest, highs),
            "Low_20": extreme_of(F.least, lows),
            "_closes": leading([v.isNotNull() for v in closes]),
            **fill("c", closes),
            **{f"_back_{k}": log_return(f"_Close_{k}", f"_Close_{k + 1}") for k in range(1, 20)},
        }
    ).drop("_ema12", "_ema26", *before)
    returns = [F.col("Return"), *[F.col(f"_back_{k}") for k in range(1, 20)]]
    closes, there = filled("c", 20), F.col("_closes")
    d = d.withColumns(
        {
            **{f"MA_{n}": F.when(there >= n, mean_of(closes[:n])) for n in (5, 10, 20)},
            "_mid_close": centre_of(closes),
            "_returns": leading([v.isNotNull() for v in returns]),
            "_finite": leading([v.isNotNull() & (F.abs(v) != float("inf")) for v in returns]),
            **fill("r", returns),
        }
    ).drop(*[f"_back_{k}" for k in range(1, 20)])
    returns, known = filled("r", 20), F.col("_returns")
    d = d.withColumns(
        {
            "BB_Std": F.when(there >= 20, F.sqrt(squares_about(closes, F.col("_mid_close")) / 19)),
            **{f"Return_MA_{n}": F.when(known >= n, mean_of(returns[:n])) for n in (5, 10, 20)},
            **{f"_mid_{n}": centre_of(returns[:n]) for n in (5, 20)},
        }
    ).drop(*[f"_c_{k}" for k in range(20)])
    d = with_moments(d)
    spread = lambda n: F.sqrt(squares_about(returns[:n], F.col(f"_mid_{n}")) / (n - 1))
    d = d.withColumns({f"Volatility_{n}": F.when(known >= n, spread(n)) for n in (5, 10, 20)})
    d = d.drop(*[f"_r_{k}" for k in range(20)])
    d = d.withColumns(
        {
            **{f"Volume_Ratio_{n}": safe_div(vol, f"Volume_MA_{n}") for n in (5, 10, 20)},
            **{f"Price_MA{n}_Ratio": safe_div(close, f"MA_{n}") for n in (5, 10, 20, 50)},
            "MA5_MA10": safe_div("MA_5", "MA_10"),
            "MA10_MA20": safe_div("MA_10", "MA_20"),
            "MA20_MA50": safe_div("MA_20", "MA_50"),
            "BB_Middle": F.col("MA_20"),
            "BB_Upper": F.col("MA_20") + F.col("BB_Std") * 2,
            "BB_Lower": F.col("MA_20") - F.col("BB_Std") * 2,
            "Price_Position_20": safe_div(close - F.col("Low_20"), F.col("High_20") - F.col("Low_20")),
            "_rs": safe_div("_avg_gain", "_avg_loss"),
        }
    )
    d = d.withColumns(
        {
            "RSI": F.lit(100.0) - safe_div(F.lit(100.0), F.lit(1.0) + F.col("_rs")),
            "BB_Width": safe_div(F.col("BB_Upper") - F.col("BB_Lower"), "BB_Middle"),
            "BB_Position": safe_div(close - F.col("BB_Lower"), F.col("BB_Upper") - F.col("BB_Lower")),
        }
    ).drop(*[c for c in d.columns if c.startswith("_mid_") or c in MOMENT_SUMS], "_rs", "_avg_gain", "_avg_loss", "_closes", "_returns", "_finite")
    # Whether all a row needs is there, known before its columns are set aside: a reader of few
    # columns then takes only those through the last window.
    needed = ["Open", "High", "Low", "Close", "Volume", "Return", *[c for c in TECHNICAL_FEATURES if c not in AFTER_EWM_9]]
    d = d.withColumn("_whole", reduce(lambda a, b: a & b, [present(d, c) for c in needed]))
    columns = d.columns
    d = held_aside(d, [key, order, *LAYOUT_COLUMNS, "_is_last", "_whole", "MACD"])
    d = with_ewm(d, "MACD", 9, "MACD_Signal", part, order, "_pos", shared, m)
    d = given_back(d, [*columns, "MACD_Signal"])
    return sf.with_df(d.withColumn("MACD_Histogram", F.col("MACD") - F.col("MACD_Signal")))


def technical_features(data: DataFrame | SeriesFrame, layout: SeriesLayout | None = None) -> SeriesFrame:
    """bars -> technical panel (Return, Target + 49 features), still in series layout.

    Drops each series' last row (P8), then rows with any undefined value (P9), then
    sets +-inf to 0 (P12 + P11).  Call .finish() for a plain DataFrame.
    """
    sf = as_series(data, layout, positioned=False)
    base = [c for c in sf.df.columns if c != "_blk"] + ["_blk"]
    sf = technical_columns(with_return_target(sf))
    keep = base + ["Return", "Target"] + TECHNICAL_FEATURES
    whole = sf.df.filter(~F.col("_is_last") & F.col("_whole"))
    d = whole.select(*keep).na.drop("any", subset=AFTER_EWM_9)
    return sf.with_df(clean(d, ["Return"] + TECHNICAL_FEATURES))


def technical_panel(bars: DataFrame, layout: SeriesLayout | None = None) -> DataFrame:
    """Convenience: plain bars DataFrame in, plain technical panel out."""
    return technical_features(bars, layout).finish()
