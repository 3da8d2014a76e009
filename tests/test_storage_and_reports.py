"""Materialised results, sinks and small options that no other test runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import SF001, make_bars, random_walk, surviving
from panelcast.operators import evaluate as ev
from panelcast.operators.indices import index_features, wide_index_table
from panelcast.operators.lags import lag_features
from panelcast.operators.splits import fold_frames
from panelcast.operators.summary import target_value_counts
from panelcast.operators.technical import technical_features
from panelcast.plans import catalog
from panelcast.plans.validation import model_summary, read_metrics, store_panel, write_metrics
from panelcast.schema import INDEX_BARS_SCHEMA
from panelcast.session import materialize, release
from panelcast.sources.files import read_bars, read_index_bars, write_bars, write_folds, write_reports


def test_live_results_do_not_break_each_other(spark):
    built = [catalog.registry()[n](spark, SF001) for n in ("confusion_matrix", "roc_auc", "equal_splits")]
    rows = [df.collect() for df in reversed(built)]
    assert len(rows[1]) == 3 and len(rows[2]) == 3


def test_keyed_results_are_written_once_and_released(spark):
    df = spark.read.parquet(f"{SF001}/region.parquet")
    one, two = (materialize(df, "once", key="k") for _ in range(2))
    assert one.inputFiles() == two.inputFiles() and one.count() == df.count()
    assert materialize(df, "once", key="other").inputFiles() != one.inputFiles()
    release(spark)
    with pytest.raises(Exception):
        one.collect()
    assert materialize(df, "once", key="k").count() == df.count()


def test_unwritable_folder_is_an_error(spark, monkeypatch):
    monkeypatch.setattr("panelcast.session.checkpoint_dir", lambda s: "/proc/nowhere")
    with pytest.raises(Exception):
        materialize(spark.range(3), "x")


def small_panel(spark):
    rows = [(t, dt.date(2020, 12, 20) + dt.timedelta(days=i), float(i), i % 3 % 2) for t in "AB" for i in range(30)]
    return spark.createDataFrame(rows, "Ticker string, Date date, x double, Target int")


def test_fold_sinks_and_frames(spark, tmp_path):
    panel = store_panel(small_panel(spark))
    day = lambda n: dt.date(2020, 12, 20) + dt.timedelta(days=n)
    folds = spark.createDataFrame([(1, day(9), day(10), day(14)), (2, day(14), day(15), day(19))], "fold long, train_end date, val_start date, val_end date")
    write_folds(panel, folds, str(tmp_path), day(25))
    count = lambda name: spark.read.parquet(str(tmp_path / name)).count()
    assert [count(f"fold_{k}_{part}") for k in (1, 2) for part in ("train", "validation")] == [20, 10, 30, 10]
    assert count("final_test") == 10
    assert spark.read.option("header", True).csv(str(tmp_path / "splits_summary")).count() == 2
    train, val = fold_frames(panel, folds, 2)
    assert (train.count(), val.count()) == (30, 10)
    assert fold_frames(panel, folds, 2, exclude_test_from=day(17))[1].count() == 4
    with pytest.raises(KeyError):
        fold_frames(panel, folds, 3)


def test_metrics_and_reports(spark, tmp_path):
    metrics = spark.createDataFrame([("b", "2", 0.5), ("a", "2", 0.6), ("b", "1", 0.7)], "model string, fold string, auc double")
    for part in (metrics.filter("fold = '1'"), metrics.filter("fold = '2'")):
        write_metrics(part, str(tmp_path / "m"))
    listed = [(r.fold, r.model) for r in model_summary(spark.read.parquet(str(tmp_path / "m"))).collect()]
    assert listed == [("1", "b"), ("2", "a"), ("2", "b")]
    write_metrics(metrics.filter("fold = '1'").withColumn("auc", F.lit(0.9)), str(tmp_path / "m"))  # a retried write
    write_metrics(metrics.filter("fold = '1'"), str(tmp_path / "m"), run="other")
    got = [(r.fold, r.model, r.auc) for r in model_summary(read_metrics(spark, str(tmp_path / "m"), "default")).collect()]
    assert got == [("1", "b", 0.9), ("2", "a", 0.6), ("2", "b", 0.5)] and read_metrics(spark, str(tmp_path / "m")).count() == 4
    write_reports({"auc": metrics}, str(tmp_path / "r"))
    write_reports({"auc": metrics}, str(tmp_path / "c"), "csv")
    assert spark.read.parquet(str(tmp_path / "r/auc")).count() == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "c/auc")).columns == metrics.columns


def test_bars_written_by_ticker_are_read_back(spark, tmp_path):
    bars = make_bars(spark, {"BRK.B": random_walk(40, 1), "A-1": random_walk(30, 2), "x y%": random_walk(3, 3), "^N+1": random_walk(4, 4)})
    write_bars(bars, str(tmp_path / "csv"))
    assert sorted(p.name for p in (tmp_path / "csv").iterdir() if not p.name.startswith(".")) == ["A-1.csv", "BRK.B.csv", "^N+1.csv", "x y%.csv"]
    got, rejects = read_bars(spark, str(tmp_path / "csv"))
    assert rejects.count() == 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, bars.collect()))


def test_value_counts_and_thresholds(spark):
    counts = [(r.Target, r["count"]) for r in target_value_counts(small_panel(spark)).collect()]
    assert counts == [(0, 40), (1, 20)]
    preds = spark.createDataFrame([(0.2,), (0.5,), (0.7,)], "probability double")
    assert [r.prediction for r in ev.threshold_predictions(preds, 0.5).orderBy("probability").collect()] == [0, 1, 1]


def test_lag_warmup_rows_can_be_dropped(spark):
    walk = random_walk(120, 4)
    tech = technical_features(make_bars(spark, {"A": walk}))
    kept, all_rows = (lag_features(tech, drop_warmup=w).finish().count() for w in (True, False))
    assert all_rows == len(surviving(walk)) and kept == all_rows - 5


def test_index_bars_source(spark, tmp_path):
    days = [dt.datetime(2020, 1, d, 23, 30) for d in (1, 2, 3, 4)]
    raw = spark.createDataFrame([("DAX", d, 1.0, 1.0, 1.0, 1.0, 1.0) for d in days] + [("X", days[0], 1.0, 1.0, 1.0, 1.0, 1.0)],
                                "IndexName string, Date timestamp, Open double, High double, Low double, Close double, Volume double")
    raw.write.parquet(str(tmp_path / "i"))
    got = read_index_bars(spark, str(tmp_path / "i"), names=["DAX"], start="2020-01-02", end="2020-01-04", zone="UTC")
    assert sorted(r.Date.day for r in got.collect()) == [2, 3]
    # 23:30 UTC is the next wall-clock day in Tokyo.
    tokyo = read_index_bars(spark, str(tmp_path / "i"), names=["DAX"], start="2020-01-02", end="2020-01-04", zone="Asia/Tokyo")
    assert sorted(r.Date.day for r in tokyo.collect()) == [2, 3] and tokyo.count() == 2


def test_index_names_that_collide_are_an_error(spark):
    day = dt.date(2020, 1, 1)
    rows = [(n, day + dt.timedelta(days=i), 1.0, 1.0, 1.0, 1.0, 1.0) for i, n in enumerate(("DAX 30", "DAX-30"))]
    with pytest.raises(Exception, match="same column name"):
        index_features(spark.createDataFrame(rows, INDEX_BARS_SCHEMA)).collect()


def test_index_lag_days(spark):
    day = dt.date(2020, 1, 1)
    feats = index_features(spark.createDataFrame([("A B", day, 1.0, 1.0, 1.0, 2.0, 1.0)], INDEX_BARS_SCHEMA))
    row = wide_index_table(feats, lag_days=2).first()
    assert row.Date == day + dt.timedelta(days=2) and row.A_B_Close == 2.0


def test_forward_fill_takes_the_last_value_of_the_tickers_own_dates(spark):
    from panelcast.operators.indices import join_index_features

    walk = random_walk(120, 1)
    days = list(walk["Date"])
    closes = {days[i]: 1000.0 + i for i in range(60, 120) if i % 7 != 3 and not 70 <= i < 80}
    bars = spark.createDataFrame([("I", d, c, c, c, c, 1.0) for d, c in closes.items()], INDEX_BARS_SCHEMA)
    sf = lag_features(technical_features(make_bars(spark, {"T": walk})))
    got = {r.Date: r.I_Close for r in join_index_features(sf, wide_index_table(index_features(bars))).finish().collect()}
    own = list(surviving(walk)["Date"])
    for d in own:
        seen = [closes[x] for x in own if x <= d and x in closes]
        assert got[d] == (seen[-1] if seen else 0.0)


def test_a_table_replaced_under_its_file_names_is_not_reused(spark, tmp_path):
    """Reuse by key sees the size and the time of change of the input files."""
    import os

    from panelcast.session import input_state, materialize, release

    path = tmp_path / "in put"
    path.mkdir()
    spark.range(5).coalesce(1).write.parquet(str(path / "a"))
    (part,) = [f for f in os.listdir(path / "a") if f.startswith("part-")]
    read = lambda: spark.read.parquet(str(path / "a"))
    first = materialize(read(), "reuse", key="k")
    again = materialize(read(), "reuse", key="k")
    assert first.inputFiles() == again.inputFiles() and first.count() == 5
    before = input_state(read())
    spark.range(9).coalesce(1).write.parquet(str(path / "b"))
    (other,) = [f for f in os.listdir(path / "b") if f.startswith("part-")]
    os.replace(path / "b" / other, path / "a" / part)
    (path / "a" / f".{part}.crc").unlink(missing_ok=True)
    assert input_state(read()) != before
    assert materialize(read(), "reuse", key="k").count() == 9 and first.count() == 5
    assert input_state(spark.range(3)) == input_state(spark.range(4))  # no files at all
    release(spark)
