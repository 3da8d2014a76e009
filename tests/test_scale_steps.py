"""Steps whose work a row must not grow with the frame, and the shape of their exchanges."""

import datetime as dt
import math
import re

from pyspark.sql import functions as F

from panelcast.functions.expr import stable_round
from panelcast.operators.lags import lag_features
from panelcast.operators.models import BOOSTED, LOGISTIC, ModelSettings, fit_models, fold_scaler_stats, model_features, scaler_stats
from panelcast.operators.series import SeriesLayout, layout_series, window_tasks
from panelcast.operators.splits import equal_split_folds, final_test_start, split_summary
from panelcast.operators.technical import technical_features
from panelcast.plans import catalog, validation
from panelcast.plans.validation import fit_groups
from panelcast.sources.files import read_bars
from panelcast.sources.tpch import bars_from_lineitem

DAY = dt.date(2020, 1, 1)


def made_bars(spark, tickers: int, days: int):
    rows = [
        (f"T{t}", DAY + dt.timedelta(d), 10.0 + d % 7, 12.0 + d % 7, 9.0 + d % 7, 11.0 + (d * (t + 3)) % 5, 100.0 + d % 3)
        for t in range(tickers)
        for d in range(days)
    ]
    return spark.createDataFrame(rows, "Ticker string, Date date, Open double, High double, Low double, Close double, Volume double")


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_window_goes_through_a_sliding_frame_again(spark):
    plan = plan_of(lag_features(technical_features(made_bars(spark, 2, 90))).finish())
    frames = re.findall(r"RowFrame, (\S+), (\S+?)\)", plan)
    sliding = [(a, b) for a, b in frames if a != "unboundedpreceding$()" and a != b]
    assert frames and not sliding, sliding


def test_last_window_copies_the_statistics_in_one_piece(spark):
    plan = plan_of(technical_features(made_bars(spark, 2, 90)).finish()).splitlines()
    last = next(i for i, line in enumerate(plan) if re.match(r"\W*Window \[", line))
    # Above the windows nothing is raised to a power again; below the last one its rows are narrow.
    assert not any("POWER(" in line for line in plan[:last])
    names = re.findall(r"(\w+)#\d+(?=[,\]])", plan[last + 1].split("Project [", 1)[1])
    assert "_held" in names and len(names) <= 16, names


def test_readers_of_few_columns_take_no_other_through_the_last_window(spark):
    rows = technical_features(made_bars(spark, 2, 90)).finish()
    plan = plan_of(rows.select("Ticker", "Date", "RSI"))
    last = plan.index("Window [")
    assert "Volume_Ratio_20" not in plan[:last] and "_whole" in plan[:last]
    assert rows.count() == rows.select("RSI").count() == 2 * 40


def test_a_row_with_nan_is_dropped_like_one_with_nothing(spark):
    bars = made_bars(spark, 1, 90)
    for value in (None, float("nan")):
        odd = F.when(F.col("Date") == F.lit(DAY + dt.timedelta(60)), F.lit(value).cast("double")).otherwise(F.col("Open"))
        assert technical_features(bars.withColumn("Open", odd)).finish().count() == 39


def test_window_tasks_follow_the_rows(spark):
    layout = SeriesLayout(task_rows=40)
    assert layout_series(made_bars(spark, 4, 90), layout).df.rdd.getNumPartitions() == 9


def test_window_tasks_of_a_large_panel_hold_more_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    lay = SeriesLayout()
    assert window_tasks(0, lay, spark) == 1 and window_tasks(50_001, lay, spark) == 2
    assert window_tasks(400_000 * 30 * cores, lay, spark) == 30 * cores
    assert window_tasks(400_000 * 30 * cores + 1, lay, spark) == 31 * cores
    small = SeriesLayout(task_rows=4, most_task_rows=40)
    rounds = max(2, -(-9 // cores))
    assert layout_series(made_bars(spark, 4, 90), small).df.rdd.getNumPartitions() == min(90, rounds * cores)


def test_files_of_a_flat_folder_are_listed_together(spark, tmp_path):
    head = "Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,100\n"
    for name in ("A.csv", "B.csv", "C.txt"):
        (tmp_path / name).write_text(head)

    def read():
        bars, _ = read_bars(spark, str(tmp_path))
        return sorted(r.Ticker for r in bars.collect()), bars._jdf.queryExecution().executedPlan().toString()

    tickers, plan = read()
    assert tickers == ["A", "B"] and "InMemoryFileIndex(1 paths)" in plan
    (tmp_path / "k=1").mkdir()  # a folder beside the files is left alone
    (tmp_path / "k=1" / "D.csv").write_text(head)
    tickers, plan = read()
    assert tickers == ["A", "B"] and "InMemoryFileIndex(2 paths)" in plan


def test_bars_are_dealt_before_they_are_aggregated(spark, tmp_path):
    row = (1, 1, 1, 1, 2.0, 10.0, dt.datetime(2020, 1, 1))
    names = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp"
    later = (2, *row[1:5], 30.0, row[6])
    spark.createDataFrame([row, row, later], names).write.parquet(f"{tmp_path}/lineitem.parquet")
    bars = bars_from_lineitem(spark, str(tmp_path))
    plan = bars._jdf.queryExecution().sparkPlan().toString()
    assert "RepartitionByExpression" in plan_of(bars) or "REPARTITION_BY_COL" in plan
    assert [tuple(r) for r in bars.collect()] == [("S1", dt.date(2020, 1, 1), 5.0, 15.0, 5.0, 15.0, 6.0)]


def test_stable_round_agrees_with_the_decimal_round(spark):
    values = [0.0, -0.0, 0.5e-6, -0.5e-6, 1.0000005, -2.34567891, 123456.789, 4.0e9, 1e15, -3e17, 1e300, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    slow = F.round(F.col("x") * (1.0 + 2.0**-40), 6)
    for fast, exact in df.select(stable_round("x", 6), F.when(slow == 0, F.lit(0.0)).otherwise(slow)).collect():
        assert fast == exact and (fast is None or math.copysign(1, fast) == math.copysign(1, exact))


def test_columns_that_no_window_needs_are_held_in_one_piece(spark):
    plan = plan_of(lag_features(technical_features(made_bars(spark, 2, 90))).finish())
    assert "_held" in plan


def test_folds_are_fitted_together_only_while_their_rows_fit():
    assert fit_groups([1, 2, 3, 4, 5], 6) == [[0, 1, 2], [3], [4]]
    assert fit_groups([9, 1, 1], 6) == [[0], [1, 2]]
    assert fit_groups([], 6) == []


def test_a_stored_training_frame_is_not_persisted(spark, monkeypatch):
    kept = []
    rows = [(float(i % 7), float(i % 3), i % 2) for i in range(40)]
    train = spark.createDataFrame(rows, "a double, b double, Target int")
    monkeypatch.setattr(type(train), "persist", lambda self, *a, **k: kept.append(1) or self)
    small = ModelSettings(gbt_iter=1, gbt_max_depth=1)
    fit_models(train, small, [BOOSTED], stored=True)
    assert not kept
    fit_models(train, small, [BOOSTED])
    assert kept


def made_panel(spark, path, tickers: int = 40, days: int = 250):
    """Rows of a panel with three features, one of them with missing, undefined and infinite values."""
    odd = [None, math.nan, math.inf, 7.0, -2.5]
    rows = [
        (f"T{t}", DAY + dt.timedelta(d), (t + d) % 3 % 2, float((t * 7 + d * 3) % 11), 1e5 + (t * d) % 17 / 16, odd[(t + d) % 5])
        for t in range(tickers)
        for d in range(days)
    ]
    spark.createDataFrame(rows, "Ticker string, Date date, Target int, a double, b double, c double").write.parquet(path)
    return spark.read.parquet(path)


def test_statistics_and_classes_of_folds_do_not_write_the_panel(spark, tmp_path, monkeypatch):
    panel = made_panel(spark, f"{tmp_path}/panel")
    written = []
    keep = catalog.materialize
    monkeypatch.setattr(catalog, "full_panel", lambda *a: panel)
    monkeypatch.setattr(catalog, "materialize", lambda df, *a, **k: written.append(df.columns) or keep(df, *a, **k))
    monkeypatch.setattr(catalog, "store_panel", lambda *a, **k: written.append("the panel") or panel)
    weights = {(r.fold, r.Target): (r.n_c, r.n, r.weight) for r in catalog.q_class_weights(spark, "-").collect()}
    stats = {(r.fold, r.feature): r for r in catalog.q_scaler_stats(spark, "-").collect()}
    assert written and all(w == ["Ticker", "Date", "Target"] for w in written), written
    rows = panel.collect()
    for fold in range(1, 6):
        train = [r for r in rows if r.Date < DAY + dt.timedelta(40 * fold)]
        ups = sum(r.Target for r in train)
        assert weights[fold, 1][:2] == (ups, len(train)) and abs(weights[fold, 1][2] - len(train) / (2 * ups)) < 1e-6
        for name in "abc":
            x = [v if v is not None and math.isfinite(v) else 0.0 for v in (r[name] for r in train)]
            mean = sum(x) / len(x)
            squares = sum((v - mean) ** 2 for v in x)
            found, exact = stats[fold, name], (mean, math.sqrt(squares / len(x)), math.sqrt(squares / (len(x) - 1)))
            assert found.n == len(train) and max(abs(u - v) for u, v in zip(found[2:5], exact)) < 2e-6, (found, exact)
    assert len(weights) == 10 and len(stats) == 15


def test_statistics_merged_from_stretches_are_those_of_all_rows(spark, tmp_path):
    panel = made_panel(spark, f"{tmp_path}/panel", 3, 20).replace(math.nan, 3.0).replace(math.inf, 3.0)
    ends = {3: DAY + dt.timedelta(18), 1: DAY + dt.timedelta(2), 2: DAY + dt.timedelta(2)}
    merged = {(r.fold, r.feature): r for r in fold_scaler_stats(panel, ["a", "b", "c"], ends).collect()}
    assert len(merged) == 9
    for fold, end in ends.items():
        for r in scaler_stats(panel.filter(F.col("Date") <= F.lit(end)), ["a", "b", "c"]).collect():
            found = merged[fold, r.feature]
            plain = panel.filter(F.col("Date") <= F.lit(end)).agg(
                F.avg(r.feature), F.stddev_pop(r.feature), F.stddev_samp(r.feature), F.count(F.lit(1))
            ).first()
            for one in (found, r):
                assert one.n == plain[3]
                assert all(abs(a - b) < 1e-9 for a, b in zip((one["mean"], one.std_pop, one.std_samp), plain[:3]))


def test_statistics_of_no_or_one_row(spark):
    rows = spark.createDataFrame([(1.0, None)], "a double, b double")
    one = {r.feature: tuple(r)[1:] for r in scaler_stats(rows, ["a", "b"]).collect()}
    assert one == {"a": (1.0, 0.0, None, 1), "b": (None, None, None, 1)}
    none = {r.feature: tuple(r)[1:] for r in scaler_stats(rows.limit(0), ["a", "b"]).collect()}
    assert none == {"a": (None, None, None, 0), "b": (None, None, None, 0)}


def test_a_stored_panel_is_not_dealt_again(spark, tmp_path, monkeypatch):
    panel = made_panel(spark, f"{tmp_path}/panel", 4, 800)
    given = []
    keep = validation.materialize
    monkeypatch.setattr(validation, "materialize", lambda df, *a, **k: given.append(df) or keep(df, *a, **k))
    name, before = "spark.sql.maxConcurrentOutputFileWriters", spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    stored = validation.store_panel(panel)
    assert "Repartition" not in plan_of(given[0]) and spark.conf.get(name, None) == before
    assert {r.year: r["count"] for r in stored.groupBy("year").count().collect()} == {2020: 4 * 366, 2021: 4 * 365, 2022: 4 * 69}
    assert sorted(map(str, stored.drop("year").collect())) == sorted(map(str, panel.collect()))


def test_learners_of_one_frame_share_its_vectors(spark, monkeypatch):
    kept = []
    rows = [(float(i % 7), float(i % 3), i % 2) for i in range(40)]
    train = spark.createDataFrame(rows, "a double, b double, Target int")
    keep = type(train).persist
    monkeypatch.setattr(type(train), "persist", lambda self, *a, **k: kept.append(self.columns) or keep(self, *a, **k))
    small = ModelSettings(gbt_iter=1, gbt_max_depth=1, lr_max_iter=5)
    fitted = fit_models(train, small, [BOOSTED, LOGISTIC])
    assert kept == [["features", "label", "weight"]]
    for model in fitted.values():  # whole pipelines: they take the panel's own columns
        assert model_features(model) == ["a", "b"] and model.transform(train).count() == 40


def test_final_models_are_fitted_beside_those_of_the_last_folds(spark, tmp_path, monkeypatch):
    panel = made_panel(spark, f"{tmp_path}/panel")
    summary = split_summary(panel, equal_split_folds(panel, 5, 0.2)[0], 1000)
    start = final_test_start(panel, 0.2)
    small, groups = ModelSettings(gbt_iter=1, gbt_max_depth=1), []
    keep = validation.fit_groups
    monkeypatch.setattr(validation, "fit_groups", lambda *a: groups.append(keep(*a)) or groups[-1])
    val, test = validation.run_all(panel, summary, start, small, [BOOSTED], rows_at_once=16_000)
    assert groups == [[[0, 1, 2, 3], [4, 5]]]  # training rows 1,600 to 8,000, and 8,000 again
    one = validation.run_validation(panel, summary, small, [BOOSTED])
    last = validation.run_final(panel, summary, start, small, [BOOSTED])
    for a, b in ((val, one), (test, last)):
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert {r.fold for r in val.select("fold").distinct().collect()} == set("12345")
    assert [r.fold for r in test.select("fold").distinct().collect()] == ["final"]
    nothing = validation.run_all(panel, summary.limit(0), start, small, [BOOSTED])
    assert [df.count() for df in nothing] == [0, 0]
