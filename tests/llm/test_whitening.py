"""Operator 12 against plain integers and a dense eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import whitening
from panelcast.llm.queries import queries
from panelcast.llm.spectra import Spectra, rank_one

SF = "/root/testdata/sf0.001"


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) and abs(1024 * c) < 2.0**62 for c in v)


def plain(rows, k=8):
    """(ids, n, deviations, eigenvalues, vectors, whitened, explained) of [(id, vector)]."""
    kept = [(i, v) for i, v in rows if usable(v)]
    dim = max((len(v) for _, v in kept), default=0)
    x = [[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (dim - len(v)) for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    dev = [sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in x]
    centred = np.array([[float(n * a - s) / n for a, s in zip(r, sums)] for r in x])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [i for i, _ in kept], n, dev, e, centred @ u / np.sqrt(np.maximum(e, 1e-300)), e / np.trace(cov)


def check(df, rows, components=8):
    ids, n, dev, e, white, explained = plain(rows, components)
    got = whitening.whiten(df, components).collect()
    k = len(e)
    assert len(got) == n * k and {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9
    have = sorted((repr(r["vec_id"]), r["component"], int(r["deviation"])) for r in got)
    assert have == sorted((repr(i), c, d) for i, d in zip(ids, dev) for c in range(1, k + 1))
    assert all(math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9) for r in got)
    unique = {i: w for i, w in zip(ids, white) if i is not None and ids.count(i) == 1}
    gaps = [min([abs(e[c] - e[j]) for j in range(k) if j != c] or [e[c]]) for c in range(k)]
    for c in range(k):
        own = {r["vec_id"]: r["whitened"] for r in got if r["component"] == c + 1 and r["vec_id"] in unique}
        a, b = np.array([own[i] for i in unique]), np.array([unique[i][c] for i in unique])
        sign = 1 if a @ b >= 0 else -1
        assert np.abs(a * sign - b).max() < 1e-9 * max(1.0, e[0] / gaps[c]), c


def as_rows(x, start=0):
    return [(start + i, [float(c) for c in v]) for i, v in enumerate(x)]


def test_equals_a_dense_decomposition(spark):
    rng = np.random.default_rng(2)
    rows = as_rows(rng.normal(size=(700, 24)) * np.linspace(0.2, 3, 24))
    rows += [(2000, None), (2001, [1.0, None] * 12), (2002, [float("nan")] * 24), (2003, [float("-inf")] * 24), (2004, [1e300] * 24)]
    rows += [(None, rows[5][1]), (7, rows[7][1]), (7, [0.5] * 24), (2005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(11)
    clash = df
    for c in ("x", "n", "component", "part", "d", "u", "mean", "deviation", "label"):
        clash = clash.withColumn(c, F.lit("x"))
    check(clash, rows)
    check(df.select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")), [(i, v if v is None else [None if c is None else float(np.float32(min(c, 3e38))) if c < 1e39 else math.inf for c in v]) for i, v in rows])


def test_given_vectors(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check(df, [(r["vec_id"], r["embedding"]) for r in df.collect()])


def test_small_and_large_scales(spark):
    rng = np.random.default_rng(4)
    rows = as_rows(rng.normal(size=(60, 5)) * [1e11, 1.0, 1e10, 1e-2, 1e12] + [0, 0, 1e11, 0, -1e13])
    check(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), rows, 3)


def test_vectors_without_spread(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    one = whitening.whiten(make([(1, [1.0, 2.0, 3.0])])).collect()
    assert [(r["component"], r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one, key=lambda r: r["component"])] == [(c, 1, 0, None, 0.0, 0.0) for c in (1, 2, 3)]
    line = whitening.whiten(make([(i, [float(i), 2.0 * i, 0.0]) for i in range(50)])).collect()
    assert {r["component"] for r in line if r["whitened"] is not None} == {1} and line[0]["identity_error"] < 1e-9
    assert whitening.whiten(make([])).collect() == [] and whitening.whiten(make([(1, []), (2, None)])).collect() == []


def test_query_columns(spark):
    df = queries()["op12_whitening"](spark, SF)
    assert dict(df.dtypes)["deviation"] == "bigint" and df.filter("deviation IS NULL OR whitened IS NULL").isEmpty()


def test_deviation_beyond_a_long_is_exact():
    w = whitening.Whitener(10**9, np.array([5, 7]), [3, 10**9 - 1], np.eye(2), np.ones(2), 2.0, 1)
    x = np.array([[10**6, -(10**6)], [5, 7]])
    want = [sum((10**9 * int(c) - (10**9 * int(p) + r)) ** 2 for c, p, r in zip(row, w.pivot, w.rest)) for row in x]
    assert w.deviations(x) == want and w.deviations(x * 10**9) == [
        sum((10**9 * int(c) - (10**9 * int(p) + r)) ** 2 for c, p, r in zip(row, w.pivot, w.rest)) for row in x * 10**9
    ]


@pytest.mark.parametrize("kind", ["spread", "equal", "low rank", "copies"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(1)
    n = 12
    x = {
        "spread": rng.normal(size=(300, n)) * 10.0 ** np.arange(-6, 6),
        "equal": np.tile(np.concatenate([np.eye(n), -np.eye(n)]), (10, 1)),
        "low rank": rng.normal(size=(200, 3)) @ rng.normal(size=(3, n)),
        "copies": np.repeat(rng.integers(0, 3, size=(20, n)), 9, axis=0).astype(float),
    }[kind]
    s = Spectra(3, n)
    for i in range(0, len(x), 3):
        s.add(x[i : i + 3])
    s = s.combined()
    c = x - x.mean(axis=0)
    want = c.T @ c
    assert np.abs(s.u[0].T @ s.u[0] - np.eye(n)).max() < 1e-12
    assert np.abs(s.u[0] * s.d[0] @ s.u[0].T - want).max() < 1e-11 * want.max()
    assert np.abs(s.d[0] - np.linalg.eigvalsh(want)).max() < 1e-11 * want.max()


def test_deflated_updates_leave_the_spectrum():
    d, u = np.array([[1.0, 2.0, 3.0]]), np.eye(3)[None]
    for v, rho in ((np.zeros((1, 3)), 1.0), (np.ones((1, 3)), 0.0)):
        values, vectors = rank_one(d, u, v, np.array([rho]))
        assert (values == d).all() and (vectors == u).all()
    values, _ = rank_one(d, u, np.array([[0.0, 1.0, 0.0]]), np.array([5.0]))
    assert np.allclose(values, [[1.0, 3.0, 7.0]])
