"""End-to-end flows on the driver's sf0.001 tables."""

from helpers import SF001
from panelcast.operators.models import ModelSettings
from panelcast.operators.splits import equal_split_folds, final_test_start, split_summary
from panelcast.plans.dataset import build_panel
from panelcast.plans.evaluation import evaluation_tables
from panelcast.plans.rules import rule_predictions
from panelcast.plans.validation import metrics_table, run_final, run_validation, store_panel, summarize
from panelcast.schema import LAG_FEATURES, TECHNICAL_FEATURES, feature_columns
from panelcast.sources.tpch import bars_from_lineitem, index_bars_from_orders


def test_build_panel_has_all_feature_families(spark):
    panel = build_panel(bars_from_lineitem(spark, SF001), index_bars_from_orders(spark, SF001))
    feats = feature_columns(panel.columns)
    assert len(feats) == len(TECHNICAL_FEATURES) + len(LAG_FEATURES) + 5 * 6
    assert panel.count() == bars_from_lineitem(spark, SF001).count() - 10 * 50  # 10 tickers, 50 rows each


def test_validation_and_final_flow(spark):
    panel = store_panel(build_panel(bars_from_lineitem(spark, SF001), index_bars_from_orders(spark, SF001)), "t")
    folds, _ = equal_split_folds(panel, 5, 0.2)
    summary = split_summary(panel, folds, min_val_rows=100)  # FIXTURES: sf0.001 windows hold ~850 rows
    assert summary.count() == 5
    s = ModelSettings(lr_max_iter=30, rf_trees=3, rf_max_depth=3, gbt_iter=2, gbt_max_depth=2)
    val = metrics_table(run_validation(panel, summary, s, folds=[1, 2]))
    test = metrics_table(run_final(panel, summary, final_test_start(panel), s))
    out = summarize(val, test).collect()
    assert len(out) == 3 and all(r.folds == 2 for r in out) and all(r.test_auc is not None for r in out)


def test_evaluation_tables_from_rule_scores(spark):
    from panelcast.operators.technical import technical_panel

    preds = rule_predictions(technical_panel(bars_from_lineitem(spark, SF001)), "all")
    tables = evaluation_tables(preds)
    assert tables["metrics"].count() == 3 and tables["roc_thresholds"].count() == 3
    assert tables["classification_report"].count() == 15


def test_storage_column_is_not_a_feature(spark):
    panel = store_panel(build_panel(bars_from_lineitem(spark, SF001)), "feat-check")
    assert "year" in panel.columns and "year" not in feature_columns(panel.columns)
