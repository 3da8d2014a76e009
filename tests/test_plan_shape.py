"""Physical-plan properties the scale design relies on (read from explain output)."""

import re

from helpers import SF001
from panelcast.operators.splits import equal_split_folds, split_summary
from panelcast.plans.dataset import build_panel
from panelcast.plans.validation import date_filter, store_panel
from panelcast.sources.tpch import bars_from_lineitem, index_bars_from_orders


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def formatted(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def test_all_panel_windows_share_one_ticker_exchange(spark):
    plan = physical(build_panel(bars_from_lineitem(spark, SF001), index_bars_from_orders(spark, SF001)))
    ticker_exchanges = re.findall(r"Exchange hashpartitioning\(Ticker#\d+, \d+\)", plan)
    assert len(ticker_exchanges) == 1, ticker_exchanges
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BroadcastHashJoin" in plan  # the calendar-sized index table
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_scan_reads_only_needed_columns(spark):
    plan = formatted(bars_from_lineitem(spark, SF001))
    schema = re.search(r"lineitem.*?ReadSchema: struct<([^>]*)>", plan, re.S).group(1)
    assert "l_returnflag" not in schema and "l_tax" not in schema


def test_fold_filters_prune_year_partitions(spark):
    panel = store_panel(build_panel(bars_from_lineitem(spark, SF001)), "plan-shape")
    folds, _ = equal_split_folds(panel, 5, 0.2)
    row = split_summary(panel, folds, min_val_rows=100).orderBy("fold").first()
    plan = formatted(date_filter(panel, lo=row["val_start"], hi=row["val_end"]))
    assert re.search(r"PartitionFilters: \[[^\]]*year", plan)
    assert re.search(r"PushedFilters: \[[^\]]*Date", plan)
