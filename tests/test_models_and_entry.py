import numpy as np
from pyspark.sql import functions as F

from helpers import make_bars, random_walk
from panelcast.operators.certificates import boosted_leaves, logistic_gradient
from panelcast.operators.models import (
    BOOSTED,
    LOGISTIC,
    ModelSettings,
    fit_models,
    load_model,
    model_features,
    prepare,
    save_models,
    score,
    score_all,
)
from panelcast.operators.technical import technical_panel
from panelcast.plans import catalog, oracle_queries
from panelcast.session import checkpoint_dir


def test_fit_score_save_load_roundtrip(spark):
    panel = technical_panel(make_bars(spark, {"A": random_walk(400, 1), "B": random_walk(400, 2)}))
    s = ModelSettings(lr_max_iter=50, rf_trees=5, rf_max_depth=3, gbt_iter=3, gbt_max_depth=2)
    models = fit_models(panel, s)
    assert set(models) == {"Logistic Regression", "Random Forest", "Gradient Boosted Trees"}
    base = f"{checkpoint_dir(spark)}/test-models"
    paths = save_models({LOGISTIC: models[LOGISTIC]}, base, 1)
    a = score(models[LOGISTIC], panel, LOGISTIC, "1").orderBy("Ticker", "Date").toPandas()
    b = score(load_model(paths[LOGISTIC]), panel, LOGISTIC, "1").orderBy("Ticker", "Date").toPandas()
    assert np.allclose(a.probability, b.probability) and a.probability.between(0, 1).all()
    every = score_all([(name, "1", m) for name, m in models.items()], panel)
    assert every._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") <= 1
    for name, m in models.items():
        own = score(m, panel, name, "1").orderBy("Ticker", "Date").toPandas()
        both = every.filter(F.col("model") == name).orderBy("Ticker", "Date").toPandas()
        assert list(own.columns) == list(both.columns) and np.allclose(own.probability, both.probability) and (own.prediction == both.prediction).all()


def test_certificates_hold_and_catch_wrong_models(spark):
    panel = technical_panel(make_bars(spark, {"A": random_walk(600, 3), "B": random_walk(500, 4)})).cache()
    s = ModelSettings(gbt_iter=6, gbt_max_depth=3)
    models = fit_models(panel, s, [LOGISTIC, BOOSTED])

    # Central differences of the loss, written out in numpy, agree with the gradient.
    found = {r.feature: r.gradient for r in logistic_gradient(models[LOGISTIC], panel).collect()}
    names = model_features(models[LOGISTIC])
    rows = prepare(panel)[0].toPandas()
    x, y = rows[names].to_numpy(), rows.label.to_numpy()
    spread = x.std(0)
    x = (x - x.mean(0)) / np.where(spread > 0, spread, 1.0)
    w = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    fitted = models[LOGISTIC].stages[-1]

    def loss(b, c):
        z = x @ b + c
        return (w * (np.logaddexp(0, z) - y * z)).sum() / w.sum() + (b @ b) / (2 * len(y))

    b, c, h = fitted.coefficients.toArray(), fitted.intercept, 1e-5
    for i, name in enumerate(names):
        step = np.eye(len(names))[i] * h
        assert abs((loss(b + step, c) - loss(b - step, c)) / (2 * h) - found[name]) < 1e-7, name
    assert len(found) == len(names) + 1 and max(abs(g) for g in found.values()) < 1e-4
    other = fit_models(panel.filter("Ticker = 'A'"), s, [LOGISTIC])[LOGISTIC]
    assert max(abs(r.gradient) for r in logistic_gradient(other, panel).collect()) > 1e-3

    leaves = boosted_leaves(models[BOOSTED], panel).toPandas()
    assert leaves.groupby("tree").n.sum().tolist() == [len(y)] * 6
    assert np.allclose(leaves.prediction, leaves.expected, rtol=0, atol=1e-9)
    strange = boosted_leaves(models[BOOSTED], panel.filter("Ticker = 'A'")).toPandas()
    assert (strange.prediction - strange.expected).abs().max() > 1e-3


def test_entry_contract(spark):
    import __spark_entry__ as e

    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs) and set(catalog.registry()) <= set(qs)
    rows_only = set(catalog.registry()) - set(oracle_queries.registry())
    assert rows_only == {"logreg_fold", "random_forest_fold", "gbt_fold", "final_models", "saved_model_roundtrip"}
    df = e.entry(spark)
    assert df.count() > 0 and "MACD_Signal" in df.columns
