import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import evaluate as ev

# Golden rows: confusion counts and printed metrics of the reference's test results
# (fixed values, model / fold, tn fp fn tp, accuracy precision recall f1).
GOLDEN = [
    ("lr", "1", 91251, 0, 100012, 0, 0.4771, 0.0000, 0.0000, 0.0000),
    ("rf", "1", 88205, 3046, 96318, 3694, 0.4805, 0.5481, 0.0369, 0.0692),
    ("gbt", "1", 89948, 1303, 98124, 1888, 0.4802, 0.5917, 0.0189, 0.0366),
    ("lr", "2", 91249, 2, 100006, 6, 0.4771, 0.7500, 0.0001, 0.0001),
    ("rf", "3", 55766, 35485, 61540, 38472, 0.4927, 0.5202, 0.3847, 0.4423),
    ("lr", "5", 69105, 22146, 72147, 27865, 0.5070, 0.5572, 0.2786, 0.3715),
    ("gbt", "5", 69637, 21614, 76237, 23775, 0.4884, 0.5238, 0.2377, 0.3270),
]


def test_golden_metrics_from_counts(spark):
    conf = spark.createDataFrame([g[:6] for g in GOLDEN], "model string, fold string, tn long, fp long, fn long, tp long")
    got = {(r.model, r.fold): r for r in ev.binary_metrics(conf).collect()}
    for g in GOLDEN:
        r = got[(g[0], g[1])]
        assert [round(r.accuracy, 4), round(r.precision, 4), round(r.recall, 4), round(r.f1, 4)] == list(g[6:])


def preds_df(spark, y, p, model="m", fold="f"):
    rows = [(model, fold, int(a), int(b >= 0.5), float(b)) for a, b in zip(y, p)]
    return spark.createDataFrame(rows, "model string, fold string, Target int, prediction int, probability double")


def brute_auc(y, p):
    pos = [s for a, s in zip(y, p) if a == 1]
    neg = [s for a, s in zip(y, p) if a == 0]
    tot = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_auc_equals_pairwise_count_with_ties(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    p = np.round(rng.uniform(0, 1, 400) * 0.3 + y * 0.2, 2)
    got = ev.roc_auc(ev.score_curve(preds_df(spark, y, p))).first()["auc"]
    assert abs(got - brute_auc(y, p)) < 1e-12


def test_curve_independent_of_range_count(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 500)
    p = np.round(rng.uniform(0, 1, 500), 3)
    d = preds_df(spark, y, p)
    a = sorted(tuple(r) for r in ev.score_curve(d, range_rows=1).collect())
    b = sorted(tuple(r) for r in ev.score_curve(d, range_rows=133).collect())
    assert a == b


def test_auc_invariant_under_monotone_transform(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    p = rng.uniform(0, 1, 300)
    a = ev.roc_auc(ev.score_curve(preds_df(spark, y, p))).first()["auc"]
    b = ev.roc_auc(ev.score_curve(preds_df(spark, y, p**3))).first()["auc"]
    assert abs(a - b) < 1e-12


def test_all_scores_equal(spark):
    y = [0, 1, 1, 0, 1]
    d = preds_df(spark, y, [0.5] * 5)
    curve = ev.score_curve(d)
    assert ev.roc_auc(curve).first()["auc"] == 0.5
    assert abs(ev.average_precision(curve).first()["average_precision"] - 0.6) < 1e-12


def test_nothing_predicted_positive(spark):
    d = preds_df(spark, [0, 1, 1], [0.1, 0.2, 0.3])
    m = ev.binary_metrics(ev.confusion(d)).first()
    assert (m.precision, m.recall, m.f1) == (0.0, 0.0, 0.0)


def test_thresholds_follow_argmax_order(spark):
    y = [1, 0, 1, 0, 1, 1, 0, 0]
    p = [0.9, 0.8, 0.7, 0.6, 0.55, 0.4, 0.3, 0.1]
    curve = ev.score_curve(preds_df(spark, y, p))
    yo = ev.youden_threshold(curve).first()
    # tpr - fpr peaks first (highest threshold) at 0.9 ... check against a direct scan
    pts = [(None, 0.0, 0.0)] + [(t, sum(a for a, s in zip(y, p) if s >= t) / 4, sum(1 - a for a, s in zip(y, p) if s >= t) / 4) for t in p]
    best = max(range(len(pts)), key=lambda i: (pts[i][1] - pts[i][2], -i))
    assert yo.optimal_threshold == pts[best][0]
    f1 = ev.f1_threshold(curve).first()
    assert 0 < f1.f1_score <= 1 and f1.f1_score == pytest.approx(f1.f1_at_threshold)


def test_reports_shapes(spark):
    d = preds_df(spark, [0, 1, 1, 0, 1], [0.2, 0.7, 0.4, 0.6, 0.9])
    conf = ev.confusion(d)
    rep = ev.classification_report(conf).collect()
    assert [r.label for r in rep] == ["Down", "Up", "accuracy", "macro avg", "weighted avg"]
    br = ev.confusion_breakdown(conf).first()
    assert br.actual_up == 3 and br.predicted_up == 3 and br.total == 5
    comp = ev.model_comparison(ev.fold_metrics(d))
    assert set(comp.columns) == {"model", "Accuracy", "Precision", "Recall", "Specificity", "F1-Score"}


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 20)), min_size=4, max_size=60))
def test_auc_property_matches_pairwise(spark, rows):
    y = [a for a, _ in rows]
    if len(set(y)) < 2:
        return
    p = [b / 20 for _, b in rows]
    got = ev.roc_auc(ev.score_curve(preds_df(spark, y, p), range_rows=100)).first()["auc"]
    assert abs(got - brute_auc(y, p)) < 1e-12


def test_curve_does_not_depend_on_its_ranges(spark):
    rng = np.random.default_rng(7)
    rows = [(m, "1", int(y), float(s)) for m in ("a", "b") for y, s in zip(rng.integers(0, 2, 900), np.round(rng.random(900), 2 if m == "a" else 9))]
    preds = spark.createDataFrame(rows, "model string, fold string, Target int, probability double")
    one = sorted(map(tuple, ev.score_curve(preds).collect()))
    for size in (1, 7, 100, 500):
        assert sorted(map(tuple, ev.score_curve(preds, range_rows=size).collect())) == one
    for m, _, s, pos, neg, tp, fp, P, N in one:
        own = [(y, x) for k, _, y, x in rows if k == m]
        assert (tp, fp) == (sum(y for y, x in own if x >= s), sum(1 - y for y, x in own if x >= s)) and P + N == 900
