import datetime as dt

import pandas as pd
import pytest

from panelcast.operators.splits import (
    Calendar,
    calendar_split_folds,
    equal_split_folds,
    final_test_start,
    plan_equal_splits,
    split_summary,
    trading_calendar,
)
from panelcast.schema import BARS_SCHEMA


def test_equal_split_arithmetic_uneven():
    plan = plan_equal_splits(103, 5, 0.2)
    assert plan.test_days == 20 and plan.fold_days == 16
    assert plan.folds[0] == (1, 15, 16, 31)
    assert plan.folds[-1] == (5, 79, 80, 95)
    assert plan.test_start_idx == 83


def test_tiny_calendar_has_empty_test_period():
    plan = plan_equal_splits(4, 5, 0.2)
    assert plan.test_days == 0 and plan.test_start_idx is None
    assert plan.folds == []  # no date to validate on


def panel(spark, n_days=400, tickers=("A", "B", "C"), start=dt.date(2019, 1, 31)):
    rows = []
    for i, t in enumerate(tickers):
        for d in range(i, n_days):  # ticker i starts i days later
            day = start + dt.timedelta(days=d)
            rows.append((t, day, 1.0, 1.0, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, BARS_SCHEMA)
    return df.withColumn("Target", (df.Ticker == "A").cast("int"))


def brute_summary(pdf: pd.DataFrame, folds: list) -> list:
    out = []
    for f in folds:
        tr = pdf[pdf.Date <= f["train_end"]]
        va = pdf[(pdf.Date >= f["val_start"]) & (pdf.Date <= f["val_end"])]
        out.append((f["fold"], tr.Date.min(), tr.Date.max(), va.Date.min(), va.Date.max(), len(tr), len(va),
                    tr.Ticker.nunique(), va.Ticker.nunique()))
    return out


def test_split_summary_matches_brute_force(spark):
    p = panel(spark)
    folds, plan = equal_split_folds(p, 5, 0.2)
    got = sorted(tuple(r) for r in split_summary(p, folds, 1).collect())
    want = brute_summary(p.toPandas(), [r.asDict() for r in folds.collect()])
    assert got == sorted(want)


def test_min_val_rows_guard(spark):
    p = panel(spark)
    folds, _ = equal_split_folds(p, 5, 0.2)
    assert split_summary(p, folds, 10**6).count() == 0


@pytest.mark.parametrize("start", [dt.date(2019, 1, 31), dt.date(2016, 2, 29)])
def test_calendar_splits_month_end_clamping(spark, start):
    p = panel(spark, n_days=3000, start=start)
    folds = {r["fold"]: r for r in calendar_split_folds(p, train_years=6, val_months=6).collect()}
    base = pd.Timestamp(start)
    for k, r in folds.items():
        vs = (base + pd.DateOffset(years=6) + (k - 1) * pd.DateOffset(months=6)).date()
        ve = ((pd.Timestamp(vs) + pd.DateOffset(months=6)) - pd.DateOffset(days=1)).date()
        assert r["val_start"] == vs and r["val_end"] == ve and r["train_end"] == vs - dt.timedelta(days=1)


def test_final_test_start(spark):
    p = panel(spark, n_days=100)
    assert final_test_start(p, 0.2) == dt.date(2019, 1, 31) + dt.timedelta(days=80)


def test_folds_are_time_ordered_on_driver_tables(spark):
    from helpers import SF001
    from panelcast.operators.technical import technical_panel
    from panelcast.sources.tpch import bars_from_lineitem

    p = technical_panel(bars_from_lineitem(spark, SF001))
    folds, _ = equal_split_folds(p, 5, 0.2)
    rows = sorted(split_summary(p, folds, 100).collect(), key=lambda r: r.fold)
    assert rows
    for a, b in zip(rows, rows[1:]):
        assert a.val_end < b.val_start and a.train_end < b.train_end
    for r in rows:
        assert r.train_end < r.val_start and r.train_start <= r.train_end


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_places_of_timestamps_by_counting(spark, kind):
    """Crowded spans are counted again by hour, minute and second; repeats and nulls take no place."""
    from pyspark.sql import functions as F

    base = dt.datetime(1969, 12, 31, 23, 59, 58)
    steps = [0, 1, 999_999, 1_000_000, 1_000_001, 2_500_000, 90_000_000, 3_700_000_000, 10**12, 10**12 + 1]
    stamps = [base + dt.timedelta(microseconds=m) for m in steps]
    rows = [(s.isoformat(sep=" "),) for s in stamps for _ in range(2)] + [(None,)]
    p = spark.createDataFrame(rows, "t string").select(F.col("t").cast(kind).alias("Date"))
    text = lambda d: [str(r[0]) for r in d.collect()]
    want = text(p.filter("Date IS NOT NULL").distinct().orderBy("Date"))
    for most in (1_000_000, 3, 1):
        cal = Calendar(p, most=most)
        got = cal.at(range(len(stamps)))
        assert cal.size == len(stamps)
        assert [str(got[i]) for i in range(len(stamps))] == want
    placed = trading_calendar(p)
    assert text(placed.orderBy("idx").select("Date")) == want
    assert sorted(r.idx for r in placed.collect()) == list(range(len(stamps)))


def test_calendar_of_an_empty_panel(spark):
    empty = panel(spark, n_days=1).limit(0)
    folds, plan = equal_split_folds(empty)
    assert plan.n_dates == 0 and folds.count() == 0 and final_test_start(empty) is None
    assert trading_calendar(empty).count() == 0


def test_calendar_has_no_window_over_all_dates(spark):
    plan = trading_calendar(panel(spark))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("[_from#" in line for line in windows)
