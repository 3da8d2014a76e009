import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelcast.functions.ewm import ewm_block_rows, with_ewms
from panelcast.functions.expr import clean, safe_div, stable_round


def test_safe_div_ieee_rules(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-2.0, 0.0), (0.0, 0.0), (None, 1.0), (3.0, None), (6.0, 3.0)], "n double, d double")
    got = [r[0] for r in df.select(safe_div("n", "d")).collect()]
    assert got == [math.inf, -math.inf, None, None, None, 2.0]


def test_clean_replaces_missing_and_infinite(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (1.5,)], "x double")
    assert [r[0] for r in clean(df).collect()] == [0.0, 0.0, 0.0, 0.0, 1.5]


def test_stable_round_ties_and_negative_zero(spark):
    df = spark.createDataFrame([(154.32125,), (-0.00001,), (0.1234565,)], "x double")
    got = [r[0] for r in df.select(stable_round("x", 4)).collect()]
    assert got[0] == 154.3213 and got[1] == 0.0 and math.copysign(1, got[1]) == 1.0


@pytest.mark.parametrize("span", [9, 12, 26])
def test_blocked_ewm_matches_pandas_across_blocks(spark, span):
    rng = np.random.default_rng(span)
    x = 100 + np.cumsum(rng.normal(0, 1, 3000))
    pdf = pd.DataFrame({"k": "a", "t": np.arange(3000), "x": x})
    df = spark.createDataFrame(pdf).withColumn("pos", F.col("t").cast("long"))
    df = df.withColumn("_blk", F.floor(F.col("pos") / 1024).cast("long"))
    out = with_ewms(df, [("x", span, "e")], ["k"], "t", "pos", ("_blk", 1024)).orderBy("t").toPandas()
    want = pd.Series(x).ewm(span=span).mean().to_numpy()
    assert np.max(np.abs(out["e"].to_numpy() - want)) < 1e-9


def test_block_rows_choice():
    assert ewm_block_rows(26, 1024) == 1024
    assert ewm_block_rows(2, 1024) < 1024  # q^-1024 would overflow
