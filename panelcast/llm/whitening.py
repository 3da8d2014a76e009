"""Operator 12: whitening of embeddings by incremental eigendecomposition.

Every task keeps the spectrum of its rows' scatter matrix and takes each row as one
centred rank-one update (`spectra`: secular equations, with deflation).  The tasks'
spectra are combined a few at a time, over some rounds, by successive rank-one updates.
The leading vectors found so are then refined over all rows: each distributed pass
multiplies the covariance with the current basis, a Rayleigh-Ritz step takes the best
vectors in it, and residuals that are still too large, divided by the distances in the
incremental spectrum, widen the basis of the next pass.

Sums over rows are exact integers; a row is centred by subtracting whole numbers first,
so that no digits are lost to a large mean.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectra import Spectra
from .store import stored

LANES = 8
FAN_IN = 8
EXTRA_VECTORS = 8
PASSES = 8
# Largest residual of a vector, as a part of the largest eigenvalue.
RESIDUAL = 2e-14
# Eigenvalues below this part of the largest are zero in double precision.
NO_SPREAD = 1e-13
WHOLE = 2.0**62


@dataclass(frozen=True)
class Whitener:
    """Mean (pivot + rest / n, exact), leading vectors as columns, eigenvalues and their sum over all dimensions."""

    n: int
    pivot: np.ndarray
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    passes: int

    @property
    def defined(self) -> np.ndarray:
        return self.values > NO_SPREAD * self.values.max(initial=0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.pivot).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened components; not a number where a component has no spread."""
        spread = np.sqrt(np.where(self.defined, self.values, np.nan))
        return self.centred(x) @ self.vectors / spread

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - S)^2, exact."""
        e, n, r = x - self.pivot, self.n, self.rest
        far, dim = int(np.abs(e).max(initial=0)), e.shape[1]
        if far * max(far, n) * dim < 2**63:
            own = np.array(r, np.int64)
            squares, cross, fixed = (e * e).sum(axis=1).tolist(), (e @ own).tolist(), sum(y * y for y in r)
            return [n * n * a - 2 * n * b + fixed for a, b in zip(squares, cross)]
        return [sum((n * c - y) ** 2 for c, y in zip(row, r)) for row in e.tolist()]


def integral(embeddings: DataFrame, scale: int, offset: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, x = floor(scale * c) + offset of every entry c.

    Rows whose vector is null, or holds an entry that is null, not finite, or too large for
    x to be a long, are left out."""
    v = F.col(vector_col)
    scaled = F.transform(v, lambda c: F.lit(float(scale)) * c.cast("double"))
    bad = F.exists(scaled, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= F.lit(WHOLE)))
    return embeddings.filter(v.isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(scaled, lambda c: F.floor(c).cast("long") + F.lit(offset)).alias("x")
    )


def _rows(batch: pa.RecordBatch, dim: int, fill: int) -> np.ndarray:
    """The column x as a matrix; vectors shorter than `dim` are filled up."""
    lists = batch.column("x")
    lengths = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    if len(flat) == len(lengths) * dim:
        return flat.reshape(len(lengths), dim)
    out = np.full((len(lengths), dim), fill, np.int64)
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def exact_sums(vectors: DataFrame, offset: int) -> tuple[int, list[int]]:
    """(number of vectors, exact sum of each dimension).  A vector's missing last entries are zeros of
    the original scale, hence `offset` here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low, held = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            lengths = np.asarray(batch.column("x").value_lengths())
            dim = max(len(high), int(lengths.max(initial=0)))
            high, low, held = (np.concatenate([a, np.zeros(dim - len(a), np.int64)]) for a in (high, low, held))
            x = _rows(batch, dim, 0)
            n += len(x)
            high += (x >> 32).sum(axis=0)  # two halves, so that no sum overflows
            low += (x & 0xFFFFFFFF).sum(axis=0)
            held += (np.arange(dim)[None, :] < lengths[:, None]).sum(axis=0)
        # Dimension -1 has the number of rows.
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *range(len(high))], pa.int32()), pa.array([n, *held.tolist()], pa.int64()),
             pa.array([0, *high.tolist()], pa.int64()), pa.array([0, *low.tolist()], pa.int64())],
            names=["dim", "n", "high", "low"],
        )

    parts = vectors.select("x").mapInArrow(run, "dim int, n long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low")]
    found = {r["dim"]: tuple(int(r[c]) for c in ("n", "high", "low")) for r in parts.groupBy("dim").agg(*exact).collect()}
    n = found.pop(-1, (0, 0, 0))[0]
    return n, [(high << 32) + low + (n - held) * offset for _, (held, high, low) in sorted(found.items())]


SPECTRUM = "part long, n double, mean array<double>, d array<double>, u array<double>"


def _spectrum_row(part: int, s: Spectra) -> pa.RecordBatch:
    lists = [pa.array([a[0].ravel()], pa.list_(pa.float64())) for a in (s.mean, s.d, s.u)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([s.n[0]]), *lists], names=["part", "n", "mean", "d", "u"])


def incremental_spectrum(vectors: DataFrame, pivot: np.ndarray, fill: int) -> Spectra:
    """Spectrum of the scatter matrix of all vectors (less `pivot`), from rank-one updates."""
    dim = len(pivot)
    lanes = int(np.clip((1 << 15) // dim**2, 1, LANES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, any_row = Spectra(lanes, dim), False
        for batch in batches:
            x = (_rows(batch, dim, fill) - pivot).astype(np.float64)
            any_row |= len(x) > 0
            for i in range(0, len(x), lanes):
                s.add(x[i : i + lanes])
        if any_row:
            yield _spectrum_row(TaskContext.get().partitionId(), s.combined())

    def combine(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")  # a retried task combines in the same order
        mean, d, u = (np.array(group[c].to_pylist()) for c in ("mean", "d", "u"))
        s = Spectra.of(np.asarray(group["n"]), mean, d, u.reshape(-1, dim, dim))
        return pa.Table.from_batches([_spectrum_row(group["part"][0].as_py() // FAN_IN, s.combined())])

    found = stored(vectors.select("x").mapInArrow(run, SPECTRUM), "spectra")
    while found.count() > 1:
        found = stored(found.groupBy(F.expr(f"part div {FAN_IN}")).applyInArrow(combine, SPECTRUM), "spectra")
    row = found.first()
    return Spectra.of(np.array([row["n"]]), np.array([row["mean"]]), np.array([row["d"]]), np.array(row["u"]).reshape(1, dim, dim))


def _summed(vectors: DataFrame, dim: int, fill: int, values: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of values(rows), a short vector: each task's sum, then those of the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = values(_rows(batch, dim, fill))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["at", "value"])

    sums = vectors.select("x").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(sums)])


def refine(vectors: DataFrame, start: Spectra, n: int, pivot: np.ndarray, rest: list[int], fill: int, components: int) -> Whitener:
    """Rayleigh-Ritz over all rows, from the incremental spectrum."""
    dim = len(pivot)
    k = min(components, dim)
    spectrum, full = start.d[0][::-1] / n, start.u[0][:, ::-1]
    basis = full[:, : min(dim, k + EXTRA_VECTORS)]
    for passes in range(1, PASSES + 1):
        basis = np.linalg.qr(basis)[0]
        here = Whitener(n, pivot, rest, basis, np.zeros(0), 0.0, passes)

        def values(x: np.ndarray, here: Whitener = here) -> np.ndarray:
            c = here.centred(x)
            return np.append((c.T @ (c @ here.vectors)).ravel(), np.einsum("ij,ij->", c, c))

        sums = _summed(vectors, dim, fill, values) / n
        image, trace = sums[:-1].reshape(basis.shape), float(sums[-1])
        small = basis.T @ image
        theta, w = np.linalg.eigh((small + small.T) / 2)
        theta, w = np.maximum(theta[::-1], 0.0), w[:, ::-1]
        ritz = basis @ w
        residual = (image @ w - ritz * theta)[:, :k]
        open_ = np.sqrt((residual**2).sum(axis=0)) > RESIDUAL * max(theta[0], np.finfo(np.float64).tiny)
        out = Whitener(n, pivot, rest, ritz[:, :k], theta[:k], trace, passes)
        if not open_.any() or basis.shape[1] == dim:
            return out
        # Where a residual is still large: its parts along the incremental vectors, each
        # divided by the distance of the eigenvalues.
        apart = spectrum[:, None] - theta[None, :k][:, open_]
        least = 1e-8 * max(theta[0], np.finfo(np.float64).tiny)
        apart = np.where(np.abs(apart) < least, np.copysign(least, apart), apart)
        wider = full @ ((full.T @ residual[:, open_]) / apart)
        size = np.sqrt((wider**2).sum(axis=0))
        basis = np.concatenate([ritz[:, : k + EXTRA_VECTORS], wider / np.where(size > 0, size, 1.0)], axis=1)[:, :dim]
    return out


RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000, id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every
    vector that `integral` keeps and every leading component (all, if the dimensions are fewer).

    All kept rows are fitted, those repeated or without an id as well; vectors shorter than
    the longest count as ending in zeros.  deviation is null beyond 38 digits.  A component
    without spread (all vectors alike in it) has a null whitened value and no part in
    identity_error (0 if none has spread); explained is 0 then.  An empty table, or vectors
    without entries, give no rows.
    """
    spark = embeddings.sparkSession
    vectors = integral(embeddings, scale, offset, id_col, vector_col)
    n, sums = exact_sums(vectors, offset)
    dim = len(sums)
    if not n or not dim:
        return spark.createDataFrame([], RESULT)
    pivot = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    model = refine(vectors, incremental_spectrum(vectors, pivot, offset), n, pivot, rest, offset, components)
    k, defined = len(model.values), model.defined

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.where(defined, model.project(x), 0.0)
        return np.append((w.T @ w).ravel(), w.sum(axis=0))

    second, first = np.split(_summed(vectors, dim, offset, moments) / n, [k * k])
    off = second.reshape(k, k) - np.outer(first, first) - np.eye(k)
    error = float(np.abs(off[np.ix_(defined, defined)]).max(initial=0.0))
    explained = model.values / model.trace if model.trace > 0 else np.zeros(k)
    most = 10**38

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, dim, offset)
            rows = len(x)
            deviations = [v if v < most else None for v in model.deviations(x)]
            each = np.repeat(np.arange(rows), k)
            whitened = model.project(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, np.int64)),
                    pa.array(deviations, pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(whitened, pa.float64(), mask=np.isnan(whitened)),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.mapInArrow(run, RESULT)
