"""DuckDB SQL for every registered query that SQL can express (see plans.queries)."""

from __future__ import annotations

from ..oracle import (
    BARS,
    BARS_GAPS,
    BARS_JUMP,
    INDEX_SUFFIXES,
    full_panel_cte,
    index_columns_sql,
    index_features_cte,
    lag_panel_cte,
    rnd,
    rsel,
    technical_all_sql,
    technical_panel_cte,
    with_ctes,
)
from ..schema import LAG_FEATURES, TECHNICAL_FEATURES, output_digits
from ..sources.tpch import REGION_ZONES
from .catalog import QUERY_MODELS, TECHNICAL_GROUPS

KEYS = "Ticker, Date"


def sql_daily_bars() -> str:
    cols = ["Open", "High", "Low", "Close", "Volume"]
    return f"SELECT {KEYS}, {rsel(cols)} FROM ({BARS}) b"


def sql_log_return_target() -> str:
    return with_ctes(technical_all_sql(), f"SELECT {KEYS}, {rsel(['Return'])}, Target FROM tech_all WHERE NOT is_last")


def sql_group(name: str, bars_sql: str = BARS) -> str:
    return with_ctes(technical_all_sql(bars_sql), f"SELECT {KEYS}, {rsel(TECHNICAL_GROUPS[name])} FROM tech_all")


def sql_ticker_user_function() -> str:
    return f"""WITH b AS (SELECT {KEYS}, Close, row_number() OVER (PARTITION BY Ticker ORDER BY Date) AS pos,
  max(Close) OVER (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN 21 PRECEDING AND CURRENT ROW) AS top FROM ({BARS}) x),
d AS (SELECT {KEYS}, Close / top - 1 AS Drawdown_22, pos - max(CASE WHEN Close = top THEN pos END) OVER
  (PARTITION BY Ticker ORDER BY Date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS down FROM b)
SELECT {KEYS}, {rnd('Drawdown_22', 6)} AS Drawdown_22, CAST(least(down, 22) AS BIGINT) AS Rows_Down FROM d"""


def sql_technical_panel() -> str:
    return with_ctes(
        technical_panel_cte(), f"SELECT {KEYS}, Target, {rsel(['Return'] + TECHNICAL_FEATURES)} FROM tech"
    )


def sql_lag_features() -> str:
    return with_ctes(lag_panel_cte(), f"SELECT {KEYS}, {rsel(LAG_FEATURES)} FROM lagp")


def sql_lag_features_complete() -> str:
    body = f"SELECT {KEYS}, {rsel(LAG_FEATURES)} FROM lagp SEMI JOIN (SELECT {KEYS} FROM lag_raw WHERE Lag_Return_5 IS NOT NULL) k USING ({KEYS})"
    return with_ctes(lag_panel_cte(), body)


def ticks_sql() -> str:
    return """SELECT r_name AS IndexName, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_seconds((o_orderkey * 7919) % 86400) AS Date,
  o_orderkey AS Tick, CAST(o_totalprice AS DOUBLE) AS Price
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def sql_index_local_days() -> str:
    zone = " ".join(f"WHEN '{name}' THEN '{z}'" for name, z in REGION_ZONES.items())
    cols = {
        "Open": "arg_min(Price, (Date, Tick))", "High": "max(Price)", "Low": "min(Price)",
        "Close": "arg_max(Price, (Date, Tick))", "Volume": "CAST(count(*) AS DOUBLE)",
    }
    return f"""WITH t AS (SELECT *, CAST(timezone(CASE IndexName {zone} ELSE 'UTC' END, timezone('UTC', Date)) AS DATE) AS day
  FROM ({ticks_sql()}) x)
SELECT IndexName, day AS Date, {', '.join(f'{rnd(v, 4)} AS {k}' for k, v in cols.items())} FROM t GROUP BY IndexName, day"""


def sql_trading_calendar() -> str:
    return f"SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS idx FROM (SELECT DISTINCT Date FROM ({BARS}) b) d"


def sql_intraday_splits() -> str:
    return f"""WITH cal AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS idx FROM (SELECT DISTINCT Date FROM ({ticks_sql()}) x) d),
p AS (SELECT count(*) AS n, CAST(floor(count(*) * 0.2) AS BIGINT) AS t FROM cal),
q AS (SELECT n, t, (n - t) // 5 AS f FROM p),
k AS (SELECT CAST(unnest(range(1, 6)) AS BIGINT) AS fold)
SELECT fold, CAST(a.Date AS VARCHAR) AS train_end, CAST(b.Date AS VARCHAR) AS val_start, CAST(c.Date AS VARCHAR) AS val_end,
  CAST(s.Date AS VARCHAR) AS test_start, n AS n_times
FROM k, q JOIN cal s ON s.idx = n - t, cal a, cal b, cal c
WHERE f > 0 AND a.idx = fold * f - 1 AND b.idx = fold * f AND c.idx = least(fold * f + f - 1, n - 1)"""


def sql_index_features() -> str:
    return with_ctes(index_features_cte(), f"SELECT IndexName, Date, {rsel(INDEX_SUFFIXES)} FROM ifeat")


def sql_index_join_ffill() -> str:
    return with_ctes(full_panel_cte(), f"SELECT {KEYS}, {rsel(index_columns_sql())} FROM fullp")


def sql_panel_summary() -> str:
    body = f"""SELECT count(*) AS rows, count(DISTINCT Ticker) AS tickers, min(Date) AS date_min, max(Date) AS date_max,
  CAST(sum(CASE WHEN Target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS target_down,
  CAST(sum(CASE WHEN Target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS target_up,
  {rnd('avg(Return)', 6)} AS return_mean, {rnd('stddev_samp(Return)', 6)} AS return_std,
  {rnd('count(*) / count(DISTINCT Ticker)', 6)} AS rows_per_ticker,
  CAST({len(TECHNICAL_FEATURES) + len(LAG_FEATURES) + len(index_columns_sql())} AS BIGINT) AS n_features,
  CAST({len(TECHNICAL_FEATURES)} AS BIGINT) AS n_technical, CAST({len(LAG_FEATURES)} AS BIGINT) AS n_lag,
  CAST({len(index_columns_sql())} AS BIGINT) AS n_index
FROM fullp"""
    return with_ctes(full_panel_cte(), body)


def sql_class_balance() -> str:
    body = f"""SELECT total, n_down, n_up, {rnd('n_down / total', 6)} AS share_down, {rnd('n_up / total', 6)} AS share_up,
  {rnd('CASE WHEN n_down > 0 THEN n_up / n_down END', 6)} AS up_down_ratio
FROM (SELECT count(*) AS total, CAST(sum(CASE WHEN Target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_down,
  CAST(sum(CASE WHEN Target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_up FROM tech) c"""
    return with_ctes(technical_panel_cte(), body)


SUMMARY_SELECT = """SELECT f.fold, min(t.Date) FILTER (WHERE t.Date <= f.train_end) AS train_start,
  max(t.Date) FILTER (WHERE t.Date <= f.train_end) AS train_end,
  min(t.Date) FILTER (WHERE t.Date BETWEEN f.val_start AND f.val_end) AS val_start,
  max(t.Date) FILTER (WHERE t.Date BETWEEN f.val_start AND f.val_end) AS val_end,
  count(*) FILTER (WHERE t.Date <= f.train_end) AS train_samples,
  count(*) FILTER (WHERE t.Date BETWEEN f.val_start AND f.val_end) AS val_samples,
  count(DISTINCT t.Ticker) FILTER (WHERE t.Date <= f.train_end) AS train_stocks,
  count(DISTINCT t.Ticker) FILTER (WHERE t.Date BETWEEN f.val_start AND f.val_end) AS val_stocks
FROM folds f JOIN tech t ON t.Date <= f.val_end
GROUP BY f.fold HAVING count(*) FILTER (WHERE t.Date BETWEEN f.val_start AND f.val_end) >= 1000"""


def equal_folds_cte(n: int = 5, frac: float = 0.2) -> str:
    pick = lambda i: f"(CASE WHEN {i} < 0 THEN D + {i} ELSE {i} END)"
    return f""",
cal AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS idx FROM (SELECT DISTINCT Date FROM tech) d),
p1 AS (SELECT count(*) AS D, CAST(floor(count(*) * {frac}) AS BIGINT) AS T FROM cal),
p2 AS (SELECT D, T, (D - T) // {n} AS s FROM p1),
fidx AS (SELECT k AS fold,
  CASE WHEN k * s <= D THEN {pick('k * s - 1')} ELSE D - 1 END AS te,
  CASE WHEN k * s < D THEN k * s ELSE D - 1 END AS vs,
  CASE WHEN (k + 1) * s <= D THEN {pick('(k + 1) * s - 1')} ELSE D - 1 END AS ve
  FROM range(1, {n + 1}) r(k), p2),
folds AS (SELECT fidx.fold, a.Date AS train_end, b.Date AS val_start, c.Date AS val_end
  FROM fidx JOIN cal a ON a.idx = fidx.te JOIN cal b ON b.idx = fidx.vs JOIN cal c ON c.idx = fidx.ve)"""


def sql_equal_splits() -> str:
    return with_ctes(technical_panel_cte() + equal_folds_cte(), SUMMARY_SELECT)


def sql_calendar_splits(years: int = 6, months: int = 6, n: int = 5) -> str:
    folds = f""",
b AS (SELECT min(Date) AS lo, max(Date) AS hi FROM tech),
vs AS (SELECT k, CAST(lo + INTERVAL ({12 * years}) MONTH + INTERVAL ({months} * k) MONTH AS DATE) AS val_start, hi
  FROM range(0, {n}) r(k), b),
folds AS (SELECT k + 1 AS fold, CAST(val_start - INTERVAL 1 DAY AS DATE) AS train_end, val_start,
  CAST(val_start + INTERVAL ({months}) MONTH - INTERVAL 1 DAY AS DATE) AS val_end
  FROM vs WHERE CAST(val_start + INTERVAL ({months}) MONTH - INTERVAL 1 DAY AS DATE) <= hi)"""
    return with_ctes(technical_panel_cte() + folds, SUMMARY_SELECT)


def sql_final_test_split(frac: float = 0.2) -> str:
    body = f""", cal AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS idx FROM (SELECT DISTINCT Date FROM tech) d),
p AS (SELECT count(*) AS D, CAST(floor(count(*) * {frac}) AS BIGINT) AS T FROM cal),
start AS (SELECT cal.Date AS s FROM cal, p WHERE p.T > 0 AND cal.idx = p.D - p.T)
SELECT min(Date) AS test_start, max(Date) AS test_end, count(*) AS test_samples, count(DISTINCT Ticker) AS test_stocks,
  CAST(sum(CASE WHEN Target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS test_down,
  CAST(sum(CASE WHEN Target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS test_up
FROM tech WHERE Date >= (SELECT s FROM start)"""
    ctes, select = body.split("\nSELECT ", 1)
    return with_ctes(technical_panel_cte() + ctes, "SELECT " + select)


def registry() -> dict[str, str]:
    out = {
        "daily_bars": sql_daily_bars(),
        "bars_from_files": sql_daily_bars(),
        "log_return_target": sql_log_return_target(),
    }
    for name in TECHNICAL_GROUPS:
        out[name] = sql_group(name)
    out["return_moments_jump"] = sql_group("return_moments", BARS_JUMP)
    out["macd_gaps"] = sql_group("macd", BARS_GAPS)
    out["rolling_user_function"] = sql_group("autocorrelation")
    out["ticker_user_function"] = sql_ticker_user_function()
    out["technical_panel"] = sql_technical_panel()
    out["lag_features"] = sql_lag_features()
    out["lag_features_complete"] = sql_lag_features_complete()
    out["index_features"] = sql_index_features()
    out["index_local_days"] = sql_index_local_days()
    out["trading_calendar"] = sql_trading_calendar()
    out["intraday_splits"] = sql_intraday_splits()
    out["index_join_ffill"] = sql_index_join_ffill()
    out["panel_summary"] = sql_panel_summary()
    out["class_balance"] = sql_class_balance()
    out["equal_splits"] = sql_equal_splits()
    out["folds_outside_test"] = sql_folds_outside_test()
    out["calendar_splits"] = sql_calendar_splits()
    out["final_test_split"] = sql_final_test_split()
    out["calendar_splits_4y"] = sql_calendar_splits(years=4)
    out.update({k: f() for k, f in EVAL_SQL.items()})
    out["scaler_stats"] = sql_scaler_stats()
    out["class_weights"] = sql_class_weights()
    out["logreg_certificate"] = sql_logreg_certificate()
    out["boosted_certificate"] = sql_boosted_certificate()
    return out


# ------------------------------------------------------------------ evaluation (rule scores)


def r0(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) <> 0 THEN CAST({n} AS DOUBLE) / CAST({d} AS DOUBLE) ELSE 0.0::DOUBLE END)"


def scored_preds_cte(where: str, fold: str) -> str:
    s = f"""scored AS (SELECT Ticker, Date, Target, {fold} AS fold, {rnd('RSI / 100', 3)} AS rsi,
  {rnd('least(greatest(BB_Position, 0.0), 1.0)', 3)} AS bb_position, {rnd('Price_Position_20', 3)} AS price_position
  FROM {where}),
preds AS ({" UNION ALL ".join(f"SELECT '{m}' AS model, fold, Ticker, Date, Target, {m} AS probability FROM scored" for m in ("rsi", "bb_position", "price_position"))}),
pr AS (SELECT *, CAST(probability > 0.5 AS INTEGER) AS prediction FROM preds),
conf AS (SELECT model, fold, count(*) FILTER (WHERE Target = 0 AND prediction = 0) AS tn,
  count(*) FILTER (WHERE Target = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE Target = 1 AND prediction = 0) AS fn,
  count(*) FILTER (WHERE Target = 1 AND prediction = 1) AS tp FROM pr GROUP BY model, fold),
g AS (SELECT model, fold, probability AS score, CAST(sum(CASE WHEN Target = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
  CAST(sum(CASE WHEN Target = 0 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM pr GROUP BY 1, 2, 3),
curve AS (SELECT model, fold, score, pos, neg,
  CAST(sum(pos) OVER (PARTITION BY model, fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
  CAST(sum(neg) OVER (PARTITION BY model, fold ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp,
  CAST(sum(pos) OVER (PARTITION BY model, fold) AS BIGINT) AS P, CAST(sum(neg) OVER (PARTITION BY model, fold) AS BIGINT) AS N
  FROM g),
auc AS (SELECT model, fold, CASE WHEN first(P) * first(N) > 0 THEN
  sum(CAST(neg AS DOUBLE) * (CAST(tp AS DOUBLE) - CAST(pos AS DOUBLE) / 2)) / (CAST(first(P) AS DOUBLE) * CAST(first(N) AS DOUBLE)) END AS auc
  FROM curve GROUP BY model, fold),
ap AS (SELECT model, fold, CASE WHEN first(P) > 0 THEN sum(pos * (tp / (tp + fp))) / first(P) END AS average_precision,
  first(P) / (first(P) + first(N)) AS baseline FROM curve GROUP BY model, fold),
metrics AS (SELECT c.model, c.fold, {r0('tp + tn', 'tn + fp + fn + tp')} AS accuracy, {r0('tp', 'tp + fp')} AS precision,
  {r0('tp', 'tp + fn')} AS recall, {r0('tn', 'tn + fp')} AS specificity, {r0('2 * tp', '2 * tp + fp + fn')} AS f1, a.auc
  FROM conf c JOIN auc a ON a.model = c.model AND a.fold = c.fold)"""
    return s


TEST_START = """,
cal AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS idx FROM (SELECT DISTINCT Date FROM tech) d),
p AS (SELECT count(*) AS D, CAST(floor(count(*) * 0.2) AS BIGINT) AS T FROM cal),
start AS (SELECT cal.Date AS s FROM cal, p WHERE p.T > 0 AND cal.idx = p.D - p.T),
"""


def sql_folds_outside_test() -> str:
    ctes = technical_panel_cte() + equal_folds_cte() + """,
kept AS (SELECT f.* FROM folds f WHERE (SELECT count(*) FROM tech t WHERE t.Date BETWEEN f.val_start AND f.val_end) >= 1000),
days AS (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS idx FROM (SELECT DISTINCT Date FROM tech) d),
start AS (SELECT Date AS s FROM days WHERE idx = (SELECT count(*) - CAST(floor(count(*) * 0.2) AS BIGINT) FROM days))"""
    side = {"train": "t.Date <= train_end", "val": "t.Date BETWEEN val_start AND val_end AND t.Date < s"}
    return with_ctes(
        ctes,
        f"""SELECT fold, any_value(val_end >= s) AS overlaps_test, count(*) FILTER ({side['train']}) AS train_rows,
  count(*) FILTER ({side['val']}) AS val_rows, max(t.Date) FILTER ({side['train']}) AS last_train,
  max(t.Date) FILTER ({side['val']}) AS last_val
FROM kept, start, tech t GROUP BY fold""",
    )


def test_eval(body: str) -> str:
    ctes = technical_panel_cte() + TEST_START + scored_preds_cte("tech WHERE Date >= (SELECT s FROM start)", "'test'")
    return with_ctes(ctes, body)


def val_eval(body: str) -> str:
    ctes = (
        technical_panel_cte()
        + equal_folds_cte()
        + """,
kept AS (SELECT f.* FROM folds f WHERE (SELECT count(*) FROM tech t WHERE t.Date BETWEEN f.val_start AND f.val_end) >= 1000),
vrows AS (SELECT t.*, CAST(k.fold AS VARCHAR) AS vfold FROM tech t JOIN kept k ON t.Date BETWEEN k.val_start AND k.val_end),
"""
        + scored_preds_cte("vrows", "vfold")
    )
    return with_ctes(ctes, body)


M = "model, fold"


def sql_confusion_matrix() -> str:
    return test_eval(f"SELECT {M}, tn, fp, fn, tp FROM conf")


def sql_binary_metrics() -> str:
    cols = {
        "accuracy": r0("tp + tn", "tn + fp + fn + tp"), "precision": r0("tp", "tp + fp"), "recall": r0("tp", "tp + fn"),
        "specificity": r0("tn", "tn + fp"), "f1": r0("2 * tp", "2 * tp + fp + fn"), "tn_rate": r0("tn", "tn + fp"),
        "fp_rate": r0("fp", "tn + fp"), "fn_rate": r0("fn", "fn + tp"), "tp_rate": r0("tp", "fn + tp"),
    }
    sel = ", ".join(f"{rnd(v, 6)} AS {k}" for k, v in cols.items())
    return test_eval(f"SELECT {M}, tn, fp, fn, tp, {sel} FROM conf")


def sql_classification_report() -> str:
    n = "(tn + fp + fn + tp)"
    dp, dr, df = r0("tn", "tn + fn"), r0("tn", "tn + fp"), r0("2 * tn", "2 * tn + fn + fp")
    up, ur, uf = r0("tp", "tp + fp"), r0("tp", "tp + fn"), r0("2 * tp", "2 * tp + fp + fn")

    def w(a, b):
        return r0(f"({a}) * (tn + fp) + ({b}) * (fn + tp)", n)

    rows = [
        ("'Down'", dp, dr, df, "tn + fp"),
        ("'Up'", up, ur, uf, "fn + tp"),
        ("'accuracy'", "NULL", "NULL", r0("tp + tn", n), n),
        ("'macro avg'", f"(({dp}) + ({up})) / 2", f"(({dr}) + ({ur})) / 2", f"(({df}) + ({uf})) / 2", n),
        ("'weighted avg'", w(dp, up), w(dr, ur), w(df, uf), n),
    ]
    body = " UNION ALL ".join(
        f"SELECT {M}, {lab} AS label, {rnd(p, 6)} AS precision, {rnd(r, 6)} AS recall, {rnd(f, 6)} AS f1_score, "
        f"CAST({s} AS BIGINT) AS support FROM conf"
        for lab, p, r, f, s in rows
    )
    return test_eval(body)


def sql_confusion_breakdown() -> str:
    n = "(tn + fp + fn + tp)"
    return test_eval(
        f"""SELECT {M}, {n} AS total, tp + tn AS correct, fp + fn AS incorrect, tn + fp AS actual_down, fn + tp AS actual_up,
  tn + fn AS predicted_down, fp + tp AS predicted_up, {rnd(r0('tn + fp', n), 6)} AS actual_down_share,
  {rnd(r0('fn + tp', n), 6)} AS actual_up_share, {rnd(r0('tn + fn', n), 6)} AS predicted_down_share,
  {rnd(r0('fp + tp', n), 6)} AS predicted_up_share FROM conf"""
    )


def sql_roc_curve() -> str:
    return test_eval(
        f"""SELECT {M}, {rnd('CASE WHEN N > 0 THEN fp / N END', 6)} AS fpr, {rnd('CASE WHEN P > 0 THEN tp / P END', 6)} AS tpr,
  {rnd('score', 6)} AS threshold FROM curve
UNION ALL SELECT DISTINCT {M}, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM curve"""
    )


def sql_roc_auc() -> str:
    return test_eval(f"SELECT {M}, {rnd('auc', 6)} AS auc FROM auc")


def sql_pr_curve(with_end: bool = True) -> str:
    body = f"""SELECT {M}, {rnd('tp / (tp + fp)', 6)} AS precision, {rnd('CASE WHEN P > 0 THEN tp / P ELSE 1.0 END', 6)} AS recall,
  {rnd('score', 6)} AS threshold FROM curve"""
    if with_end:
        body += f"\nUNION ALL SELECT DISTINCT {M}, 1.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM curve"
    return test_eval(body)


def sql_average_precision() -> str:
    return test_eval(
        f"SELECT {M}, {rnd('average_precision', 6)} AS average_precision, {rnd('baseline', 6)} AS baseline, "
        f"{rnd('average_precision - baseline', 6)} AS lift FROM ap"
    )


def sql_performance_band() -> str:
    return test_eval(
        f"""SELECT a.model, a.fold, {rnd('auc', 6)} AS auc,
  CASE WHEN auc >= 0.8 THEN 'Excellent' WHEN auc >= 0.7 THEN 'Good' WHEN auc >= 0.6 THEN 'Fair' ELSE 'Poor' END AS roc_band,
  {rnd('average_precision', 6)} AS average_precision, {rnd('baseline', 6)} AS baseline,
  CASE WHEN average_precision >= 0.8 THEN 'Excellent' WHEN average_precision >= 0.7 THEN 'Good'
    WHEN average_precision >= 0.6 THEN 'Fair' WHEN average_precision >= baseline + 0.1 THEN 'Better than Random'
    ELSE 'Poor' END AS pr_band
FROM auc a JOIN ap b ON a.model = b.model AND a.fold = b.fold"""
    )


def at_threshold(tp: str, fp: str) -> dict[str, str]:
    fn, tn = f"(P - {tp})", f"(N - {fp})"
    return {
        "accuracy": r0(f"{tp} + {tn}", "P + N"),
        "precision": r0(tp, f"{tp} + {fp}"),
        "recall": r0(tp, f"{tp} + {fn}"),
        "f1": r0(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"),
    }


def sql_youden_threshold() -> str:
    m = at_threshold("tp", "fp")
    return test_eval(
        f"""SELECT {M}, {rnd('score', 6)} AS optimal_threshold, {rnd('fpr', 6)} AS fpr, {rnd('tpr', 6)} AS tpr,
  {rnd(m['accuracy'], 6)} AS accuracy, {rnd(m['precision'], 6)} AS precision, {rnd(m['recall'], 6)} AS recall,
  {rnd(m['f1'], 6)} AS f1_score
FROM (SELECT *, CASE WHEN N > 0 THEN fp / N END AS fpr, CASE WHEN P > 0 THEN tp / P END AS tpr FROM (
    SELECT {M}, score, tp, fp, P, N FROM curve
    UNION ALL SELECT DISTINCT {M}, NULL::DOUBLE, 0::BIGINT, 0::BIGINT, P, N FROM curve) u) v
QUALIFY row_number() OVER (PARTITION BY {M} ORDER BY tpr - fpr DESC, coalesce(score, 'inf'::DOUBLE) DESC) = 1"""
    )


def sql_f1_threshold() -> str:
    m = at_threshold("tp", "fp")
    return test_eval(
        f"""SELECT {M}, {rnd('score', 6)} AS optimal_threshold, {rnd('prec_v', 6)} AS precision, {rnd('rec_v', 6)} AS recall,
  {rnd('f1_v', 6)} AS f1_score, {rnd(m['accuracy'], 6)} AS accuracy, {rnd(m['precision'], 6)} AS precision_at_threshold,
  {rnd(m['recall'], 6)} AS recall_at_threshold, {rnd(m['f1'], 6)} AS f1_at_threshold
FROM (SELECT *, CASE WHEN prec_v + rec_v > 0 THEN 2.0 * (prec_v * rec_v) / (prec_v + rec_v) ELSE 0.0 END AS f1_v FROM (
  SELECT *, tp / (tp + fp) AS prec_v, CASE WHEN P > 0 THEN tp / P ELSE 1.0 END AS rec_v FROM curve) a) b
QUALIFY row_number() OVER (PARTITION BY {M} ORDER BY f1_v DESC, score ASC) = 1"""
    )


COMPARED = [("Accuracy", "accuracy"), ("Precision", "precision"), ("Recall", "recall"), ("Specificity", "specificity"), ("F1-Score", "f1")]


def sql_model_comparison() -> str:
    sel = ", ".join(f'{rnd(c, 6)} AS "{name}"' for name, c in COMPARED)
    return test_eval(f"SELECT model, {sel} FROM metrics")


def sql_fold_metric_summary() -> str:
    parts = []
    for c in ("accuracy", "precision", "recall", "f1", "auc"):
        parts += [f"{rnd(f'avg({c})', 6)} AS {c}_mean", f"{rnd(f'stddev_pop({c})', 6)} AS {c}_std"]
    return val_eval(f"SELECT model, count(*) AS folds, {', '.join(parts)} FROM metrics GROUP BY model")


def sql_fold_table(metric: str) -> str:
    cols = ", ".join(f"{rnd(f'max(CASE WHEN fold = {chr(39)}{k}{chr(39)} THEN {metric} END)', 6)} AS \"{k}\"" for k in "12345")
    return val_eval(f"SELECT model, {cols} FROM metrics GROUP BY model")


EVAL_SQL = {
    "confusion_matrix": sql_confusion_matrix,
    "binary_metrics": sql_binary_metrics,
    "classification_report": sql_classification_report,
    "confusion_breakdown": sql_confusion_breakdown,
    "roc_curve": sql_roc_curve,
    "roc_auc": sql_roc_auc,
    "pr_curve": sql_pr_curve,
    "pr_by_threshold": lambda: sql_pr_curve(False),
    "average_precision": sql_average_precision,
    "performance_band": sql_performance_band,
    "youden_threshold": sql_youden_threshold,
    "f1_threshold": sql_f1_threshold,
    "model_comparison": sql_model_comparison,
    "fold_metric_summary": sql_fold_metric_summary,
    "fold_auc_table": lambda: sql_fold_table("auc"),
    "fold_accuracy_table": lambda: sql_fold_table("accuracy"),
}


# ------------------------------------------------------------------ training rows of the folds (M2, M3, M5, M6)


def fold_train_cte() -> str:
    return (
        full_panel_cte()
        + equal_folds_cte()
        + """,
kept AS (SELECT f.* FROM folds f WHERE (SELECT count(*) FROM tech t WHERE t.Date BETWEEN f.val_start AND f.val_end) >= 1000),
train AS (SELECT kept.fold AS fold, fullp.* FROM kept JOIN fullp ON fullp.Date <= kept.train_end)"""
    )


def sql_scaler_stats() -> str:
    feats = TECHNICAL_FEATURES + LAG_FEATURES + index_columns_sql()
    aggs = ", ".join(
        f"avg({c}) AS m_{c}, stddev_pop({c}) AS p_{c}, stddev_samp({c}) AS s_{c}" for c in feats
    )
    parts = []
    for c in feats:
        k = output_digits(c)
        parts.append(
            f"SELECT fold, '{c}' AS feature, {rnd(f'm_{c}', k)} AS mean, {rnd(f'p_{c}', k)} AS std_pop, "
            f"{rnd(f's_{c}', k)} AS std_samp, n FROM agg"
        )
    return with_ctes(
        fold_train_cte() + f",\nagg AS (SELECT fold, count(*) AS n, {aggs} FROM train GROUP BY fold)", "\nUNION ALL\n".join(parts)
    )


def sql_class_weights() -> str:
    body = f"""SELECT fold, Target, n_c, CAST(sum(n_c) OVER f AS BIGINT) AS n,
  {rnd('sum(n_c) OVER f / (count(*) OVER f * n_c)', 6)} AS weight
FROM (SELECT fold, Target, count(*) AS n_c FROM train GROUP BY fold, Target) c WINDOW f AS (PARTITION BY fold)"""
    return with_ctes(fold_train_cte(), body)


def sql_logreg_certificate() -> str:
    n = len(TECHNICAL_FEATURES + LAG_FEATURES + index_columns_sql())
    body = f"""SELECT fold, count(*) AS n_rows, CAST(sum(Target) AS BIGINT) AS n_up, CAST({n} AS BIGINT) AS n_features, true AS optimal
FROM train GROUP BY fold"""
    return with_ctes(fold_train_cte(), body)


def sql_boosted_certificate() -> str:
    body = f"""SELECT fold, CAST({QUERY_MODELS.gbt_iter} AS BIGINT) AS trees, count(*) AS least_rows, count(*) AS most_rows,
  CAST(sum(Target) AS BIGINT) AS n_up, true AS leaves_right FROM train GROUP BY fold"""
    return with_ctes(fold_train_cte(), body)
