import math
import os
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from panelcast.llm import topk
from panelcast.llm.queries import queries
from panelcast.session import checkpoint_dir

SF = "/root/testdata/sf0.001"


def plain_top(rows, k=20):
    use = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in use if i % 20 == 0}):
        mine = min(v for i, v in use if i == q)
        scored = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in use if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def answer(df, **kw):
    return sorted((tuple(r) for r in topk.top_k(df, **kw).select("query_id", "rank", "vec_id", "score").collect()), key=lambda r: r[:3])


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    points = np.round(rng.normal(size=(900, 6)), 1)
    points[100:400] = points[100]  # ties
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(points)]
    rows += [(2000, None), (2020, [1.0, None] * 3), (2040, [float("nan")] * 6), (2060, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    rows += [(40, rows[40][1]), (40, [2.0] * 6), (7, rows[7][1]), (2080, [1.0]), (2100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("block", F.lit("y"))
    want = plain_top(rows)
    assert answer(df) == want
    assert answer(df, shard_rows=150, block_rows=5) == want
    assert topk.top_k(df.filter("1 = 0")).collect() == []
    assert answer(df.filter("vec_id < 5")) == plain_top([r for r in rows if r[0] is not None and r[0] < 5])


def test_components_of_any_size(spark):
    rng = np.random.default_rng(8)
    points = np.round(rng.normal(size=(120, 5)), 2)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(points)]
    rows += [(200, [5000.0] * 5), (201, [1e6, -1e6, 3.5, 0.0, 1.0]), (220, [1e18, 1.0, 0.0, -2.0, 5.0]), (221, [1e18, 1.0, 0.0, -2.0, 5.02])]
    rows += [(240, [1e300, 0.0, 0.0, 0.0, 1.0]), (241, [-1e300, 1e300, 7.0, 0.0, 0.0]), (260, [1.7e308] * 5), (261, [-1.7e308] * 5), (262, [2.0**45, 0.1, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = [(i, [math.floor(64 * Fraction(x)) for x in v]) for i, v in rows]
    want = []
    for q, mine in exact:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(mine, v)), i) for i, v in exact if i != q)[:20]
            want += [(q, n + 1, i, -s if abs(s) < 2**63 else None) for n, (s, i) in enumerate(scored)]
    for kw in ({}, {"shard_rows": 30, "block_rows": 2}):
        assert answer(df, **kw) == sorted(want)


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert answer(df) == plain_top([(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF)
        assert seen.columns == docs.columns and 0 < seen.count() <= 2 * docs.count(), name
    folder = f"{checkpoint_dir(spark)}/panelcast"
    written = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, SF)
    assert [n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - written] == ["llm-mix_sources"]
    assert {r["doc_id"] for r in out.collect()} <= {r["doc_id"] for r in docs.collect()}


def test_pipeline_on_odd_rows(spark, odd_docs):
    for table in (odd_docs, odd_docs.filter("1 = 0")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            out.collect()
            if name != "encode":
                assert out.columns == table.columns, name


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
