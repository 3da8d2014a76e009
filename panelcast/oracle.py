"""DuckDB SQL for the correctness oracle: the same semantics written independently
as window SQL over the driver's parquet views.

Helpers mirror `functions.expr`: guarded division (x/0 -> +-inf, 0/0 -> null),
"full frame" rolling statistics, and `rnd`, the engine-stable rounding.
"""

from __future__ import annotations


from .schema import LAG_FEATURES, TECHNICAL_FEATURES, output_digits

BIAS = "1.0000000000009095::DOUBLE"  # 1 + 2**-40, see functions.expr.stable_round
W = "PARTITION BY Ticker ORDER BY Date"


def rnd(x: str, k: int) -> str:
    r = f"round(({x}) * {BIAS}, {k})"
    return f"(CASE WHEN {r} = 0 THEN 0.0::DOUBLE ELSE {r} END)"


def sdiv(n: str, d: str) -> str:
    return (
        f"(CASE WHEN ({d}) <> 0 THEN ({n}) / ({d}) WHEN ({d}) = 0 AND ({n}) > 0 THEN 'inf'::DOUBLE "
        f"WHEN ({d}) = 0 AND ({n}) < 0 THEN '-inf'::DOUBLE END)"
    )


def frame(n: int, end: int = 0, part: str = W) -> str:
    start = end - (n - 1)
    lo = f"{-start} PRECEDING" if start < 0 else ("CURRENT ROW" if start == 0 else f"{start} FOLLOWING")
    hi = f"{-end} PRECEDING" if end < 0 else ("CURRENT ROW" if end == 0 else f"{end} FOLLOWING")
    return f"({part} ROWS BETWEEN {lo} AND {hi})"


def roll(fn: str, x: str, n: int, end: int = 0, part: str = W) -> str:
    f = frame(n, end, part)
    return f"(CASE WHEN count({x}) OVER {f} = {n} THEN {fn}({x}) OVER {f} END)"


def clean0(x: str) -> str:
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) OR isinf({x}) THEN 0.0::DOUBLE ELSE ({x}) END)"


# ---------------------------------------------------------------- bars (FIXTURES A)

BARS = """
SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS Ticker, CAST(l_shipdate AS DATE) AS Date,
  first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS Open,
  max(l_extendedprice / l_quantity) AS High,
  min(l_extendedprice / l_quantity) AS Low,
  first(l_extendedprice / l_quantity ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) AS Close,
  sum(CAST(l_quantity AS DOUBLE)) AS Volume
FROM lineitem GROUP BY 1, 2
"""

NTH = f"row_number() OVER ({W})"

# One tick a hundred times too high in each ticker; every 97th close missing.
BARS_JUMP = f"SELECT * REPLACE (CASE WHEN {NTH} = 100 THEN Close * 100 ELSE Close END AS Close) FROM ({BARS})"
BARS_GAPS = f"SELECT * REPLACE (CASE WHEN {NTH} % 97 = 0 THEN NULL ELSE Close END AS Close) FROM ({BARS})"

INDEX_BARS = """
SELECT r_name AS IndexName, CAST(o_orderdate AS DATE) AS Date, avg(o_totalprice) AS Close
FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY 1, 2
"""


def ewm_sql(x: str, span: float, part: str = "Ticker", order: str = "Date", pos: str = "pos") -> str:
    q = 1.0 - 2.0 / (span + 1.0)
    cum = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    num = f"sum(({x}) * pow({q!r}, -{pos})) OVER {cum}"
    den = f"sum(CASE WHEN ({x}) IS NOT NULL THEN pow({q!r}, -{pos}) END) OVER {cum}"
    return f"(({num}) / ({den}))"


def technical_all_sql(bars_sql: str = BARS) -> str:
    """CTE chain: every technical column on every bar (nulls where undefined)."""
    skew_n, kurt_n = 10, 10
    c10 = frame(10)
    flat10 = f"max(Return) OVER {c10} = min(Return) OVER {c10}"
    full10 = f"count(Return) OVER {c10} = 10"
    var10 = f"var_pop(Return) OVER {c10}"

    def autocorr(k: int) -> str:
        f = frame(20 - k)
        vx, vy = f"var_pop(Return) OVER {f}", f"var_pop(rl{k}) OVER {f}"
        r = f"covar_pop(Return, rl{k}) OVER {f} / sqrt({vx} * {vy})"
        return (
            f"(CASE WHEN count(Return) OVER {frame(20)} = 20 AND {vx} > 0 AND {vy} > 0 "
            f"THEN greatest(-1.0, least(1.0, {r})) END)"
        )

    level3 = {
        "Price_Range": "High - Low",
        "Price_Range_Pct": sdiv("High - Low", "Close"),
        "Open_Close_Range": sdiv("abs(Open - Close)", "Close"),
        "High_Close_Range": sdiv("High - Close", "Close"),
        "Low_Close_Range": sdiv("Close - Low", "Close"),
        **{f"Volume_MA_{n}": roll("avg", "Volume", n) for n in (5, 10, 20)},
        **{f"MA_{n}": roll("avg", "Close", n) for n in (5, 10, 20, 50)},
        **{f"Volatility_{n}": roll("stddev_samp", "Return", n) for n in (5, 10, 20)},
        **{f"Momentum_{n}": f"{sdiv('Close', f'c{n}')} - 1" for n in (5, 10, 20)},
        "avg_gain": roll("avg", "gain", 14),
        "avg_loss": roll("avg", "loss", 14),
        "BB_Std": roll("stddev_samp", "Close", 20),
        "High_20": roll("max", "High", 20),
        "Low_20": roll("min", "Low", 20),
        **{f"Return_MA_{n}": roll("avg", "Return", n) for n in (5, 10, 20)},
        "Return_Skew_10": (
            f"(CASE WHEN {full10} AND {flat10} THEN 0.0 WHEN {full10} AND {var10} > 1e-14 "
            f"THEN skewness(Return) OVER {c10} END)"
        ),
        "Return_Kurt_10": (
            f"(CASE WHEN {full10} AND {flat10} THEN -3.0 WHEN {full10} AND {var10} > 1e-14 "
            f"THEN kurtosis(Return) OVER {c10} END)"
        ),
        **{f"Autocorr_{k}": autocorr(k) for k in (1, 2, 5)},
        "ema12": ewm_sql("Close", 12),
        "ema26": ewm_sql("Close", 26),
    }
    level4 = {
        **{f"Volume_Ratio_{n}": sdiv("Volume", f"Volume_MA_{n}") for n in (5, 10, 20)},
        **{f"Price_MA{n}_Ratio": sdiv("Close", f"MA_{n}") for n in (5, 10, 20, 50)},
        "MA5_MA10": sdiv("MA_5", "MA_10"),
        "MA10_MA20": sdiv("MA_10", "MA_20"),
        "MA20_MA50": sdiv("MA_20", "MA_50"),
        "BB_Middle": "MA_20",
        "BB_Upper": "MA_20 + BB_Std * 2",
        "BB_Lower": "MA_20 - BB_Std * 2",
        "Price_Position_20": sdiv("Close - Low_20", "High_20 - Low_20"),
        "rs": sdiv("avg_gain", "avg_loss"),
        "MACD": "ema12 - ema26",
    }
    level5 = {
        "RSI": f"100.0 - {sdiv('100.0', '1.0 + rs')}",
        "BB_Width": sdiv("BB_Upper - BB_Lower", "BB_Middle"),
        "BB_Position": sdiv("Close - BB_Lower", "BB_Upper - BB_Lower"),
        "MACD_Signal": ewm_sql("MACD", 9),
    }

    def sel(d: dict[str, str]) -> str:
        return ",\n  ".join(f"{v} AS {k}" for k, v in d.items())

    del skew_n, kurt_n
    return f"""
bars AS ({bars_sql}),
t0 AS (
  SELECT *, row_number() OVER ({W}) - 1 AS pos,
    lag(Close) OVER ({W}) AS prev_close, lead(Close) OVER ({W}) AS next_close,
    lead(Date) OVER ({W}) IS NULL AS is_last,
    lag(Close, 5) OVER ({W}) AS c5, lag(Close, 10) OVER ({W}) AS c10, lag(Close, 20) OVER ({W}) AS c20
  FROM bars),
t1 AS (
  SELECT *, ln(Close / prev_close) AS Return,
    coalesce(CAST(ln(next_close / Close) > 0 AS INTEGER), 0) AS Target,
    CASE WHEN Close - prev_close > 0 THEN Close - prev_close ELSE 0.0 END AS gain,
    CASE WHEN Close - prev_close < 0 THEN prev_close - Close ELSE 0.0 END AS loss
  FROM t0),
t2 AS (
  SELECT *, lag(Return, 1) OVER ({W}) AS rl1, lag(Return, 2) OVER ({W}) AS rl2, lag(Return, 5) OVER ({W}) AS rl5
  FROM t1),
t3 AS (SELECT *,
  {sel(level3)}
  FROM t2),
t4 AS (SELECT *,
  {sel(level4)}
  FROM t3),
tech_all AS (SELECT *,
  {sel(level5)},
  MACD - {ewm_sql("MACD", 9)} AS MACD_Histogram
  FROM t4)"""


def technical_panel_cte(bars_sql: str = BARS) -> str:
    """tech_all -> drop last rows and undefined rows -> inf to 0 (CTE `tech`)."""
    required = ["Open", "High", "Low", "Close", "Volume", "Return"] + TECHNICAL_FEATURES
    not_null = " AND ".join(f"{c} IS NOT NULL" for c in required)
    cleaned = ", ".join(f"{clean0(c)} AS {c}" for c in ["Return"] + TECHNICAL_FEATURES)
    return technical_all_sql(bars_sql) + f""",
tech AS (
  SELECT Ticker, Date, Open, High, Low, Close, Volume, Target, {cleaned}
  FROM tech_all WHERE NOT is_last AND {not_null})"""


def lag_panel_cte(bars_sql: str = BARS) -> str:
    """tech -> 21 lag features over surviving rows, missing -> 0 (CTE `lagp`)."""
    lagged = {f"Lag_Return_{k}": f"lag(Return, {k}) OVER ({W})" for k in (1, 2, 3, 4, 5, 10, 15, 20, 22)}
    lagged.update(
        {
            "Lag_Return_Mean_5": roll("avg", "Return", 5, -1),
            "Lag_Return_Mean_22": roll("avg", "Return", 22, -1),
            "Lag_Return_Std_5": roll("stddev_samp", "Return", 5, -1),
            "Lag_Return_Std_22": roll("stddev_samp", "Return", 22, -1),
            "Lag_Price_MA5_Ratio_1": f"lag(Price_MA5_Ratio, 1) OVER ({W})",
            "Lag_Price_MA5_Ratio_5": f"lag(Price_MA5_Ratio, 5) OVER ({W})",
            "Lag_Price_MA20_Ratio_1": f"lag(Price_MA20_Ratio, 1) OVER ({W})",
            "Lag_Price_MA20_Ratio_5": f"lag(Price_MA20_Ratio, 5) OVER ({W})",
            "Lag_Volume_Ratio_5_1": f"lag(Volume_Ratio_5, 1) OVER ({W})",
            "Lag_Volume_Ratio_5_5": f"lag(Volume_Ratio_5, 5) OVER ({W})",
            "Lag_Volatility_5_1": f"lag(Volatility_5, 1) OVER ({W})",
            "Lag_Volatility_20_1": f"lag(Volatility_20, 1) OVER ({W})",
        }
    )
    assert list(lagged) == LAG_FEATURES
    raw = ",\n  ".join(f"{v} AS {k}" for k, v in lagged.items())
    cleaned = ", ".join(f"{clean0(c)} AS {c}" for c in LAG_FEATURES)
    base = ", ".join(["Ticker", "Date", "Open", "High", "Low", "Close", "Volume", "Target", "Return"] + TECHNICAL_FEATURES)
    return technical_panel_cte(bars_sql) + f""",
lag_raw AS (SELECT *,
  {raw}
  FROM tech),
lagp AS (SELECT {base}, {cleaned} FROM lag_raw)"""


def with_ctes(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip().rstrip(',')}\n{body}"


def rsel(cols: list[str], doubles: set[str] | None = None) -> str:
    """Select list that rounds the given double columns like queries.rounded()."""
    out = []
    for c in cols:
        if doubles is None or c in doubles:
            out.append(f"{rnd(c, output_digits(c))} AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


# ---------------------------------------------------------------- index features (FIXTURES B)

# TPC-H region names, i.e. the index series of the stand-in data.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
WI = "PARTITION BY IndexName ORDER BY Date"


def region_col(name: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in name)


def index_features_cte() -> str:
    return f"""
ib AS ({INDEX_BARS}),
if1 AS (SELECT regexp_replace(trim(IndexName), '[^A-Za-z0-9]', '_', 'g') AS IndexName, Date, Close,
  ln(Close / lag(Close) OVER ({WI})) AS Return FROM ib),
if2 AS (SELECT *, {roll('avg', 'Close', 5, part=WI)} AS MA_5, {roll('avg', 'Close', 20, part=WI)} AS MA_20,
  {roll('stddev_samp', 'Return', 20, part=WI)} AS Volatility_20 FROM if1),
ifeat AS (SELECT IndexName, Date, Close, Return, MA_5, MA_20, Volatility_20,
  {sdiv('Close', 'MA_20')} AS Price_MA20_Ratio FROM if2)"""


INDEX_SUFFIXES = ["Close", "Return", "MA_5", "MA_20", "Volatility_20", "Price_MA20_Ratio"]


def index_columns_sql() -> list[str]:
    return [f"{region_col(r)}_{s}" for r in REGIONS for s in INDEX_SUFFIXES]


def full_panel_cte() -> str:
    """lagp LEFT JOIN wide index table ON Date -> per-ticker forward fill -> 0 (CTE `fullp`)."""
    wide_cols = ", ".join(
        f"max(CASE WHEN IndexName = '{region_col(r)}' THEN {s} END) AS {region_col(r)}_{s}"
        for r in REGIONS
        for s in INDEX_SUFFIXES
    )
    cols = index_columns_sql()
    up = f"({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ff = ", ".join(f"last_value({c} IGNORE NULLS) OVER {up} AS {c}" for c in cols)
    cleaned = ", ".join(f"{clean0(c)} AS {c}" for c in cols)
    return lag_panel_cte() + "," + index_features_cte() + f""",
wide AS (SELECT Date, {wide_cols} FROM ifeat GROUP BY Date),
joined AS (SELECT l.*, {", ".join("w." + c for c in cols)} FROM lagp l LEFT JOIN wide w ON l.Date = w.Date),
filled AS (SELECT * EXCLUDE ({", ".join(cols)}), {ff} FROM joined),
fullp AS (SELECT * EXCLUDE ({", ".join(cols)}), {cleaned} FROM filled)"""
