"""Operator 10: exact top-k inner products by branch and bound over ball trees.

Candidates are dealt into shards and queries into blocks, both of bounded size; every
(block, shard) pair is one task's group.  A shard's vectors form a ball tree; a node's
inner product with a query is at most that with its centre plus its radius times the
query's length.  A query opens nodes in the order of that bound and stops where the
bound is below its k-th score.  The k-th score found in one home shard goes along with
the query to all others, which so open few nodes and return few rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

SHARD_ROWS = 16_384
BLOCK_ROWS = 2_048
LEAF_ROWS = 128


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) / scale, exact for components of any finite size.

    They are kept as multiples of 1 / scale (a power of two), which no component overflows.  Rows with a null id, a null vector or a null or
    non-finite component take no part."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    floor = lambda c: F.when(F.abs(c) < F.lit(2.0**53), F.floor(F.lit(float(scale)) * c).cast("double") / scale).otherwise(c)
    return (
        embeddings.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(True)))
        .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: floor(c.cast("double"))).alias("v"))
    )


def integers(rows: np.ndarray, scale: int) -> np.ndarray:
    """Exact Python integers scale * v of rows whose entries are multiples of 1 / scale."""
    return np.array([[int(c * scale) if abs(c) < 2.0**900 else int(c) * scale for c in r] for r in rows.tolist()], object).reshape(rows.shape)


class BallTree:
    """Balls over the rows of `points`, halved at the median along their widest spread."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> None:
        self.order = np.arange(len(points))
        self.points = points
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, left, right (-1: a leaf)
        centres, radii = [], []
        stack = [(0, len(points), -1, False)]
        while stack:
            lo, hi, parent, is_right = stack.pop()
            own = points[self.order[lo:hi]]
            centre = own.mean(axis=0)
            apart = own - centre
            far = np.einsum("ij,ij->i", apart, apart)
            centres.append(centre)
            radii.append(np.sqrt(far.max()))
            me = len(self.nodes)
            self.nodes.append((lo, hi, -1, -1))
            if parent >= 0:
                s, e, left, right = self.nodes[parent]
                self.nodes[parent] = (s, e, left, me) if is_right else (s, e, me, right)
            if hi - lo > leaf_rows and far.max() > 0:
                axis = apart[far.argmax()]
                other = own[((own - own[far.argmax()]) ** 2).sum(axis=1).argmax()] - own[far.argmax()]
                along = own @ (other if other.any() else axis)
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(along, mid)]
                stack.append((lo + mid, hi, me, True))
                stack.append((lo, lo + mid, me, False))
        self.centres, self.radii = np.array(centres), np.array(radii)

    def leaf_bounds(self, queries: np.ndarray, lengths: np.ndarray, floor: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """(row spans of the leaves, upper bound of every query in every leaf).

        Going down from the root, a subtree whose bound is below a query's floor is cut
        off for it: all its leaves get -inf."""
        spans, bounds = [], []
        stack = [(0, np.zeros(len(queries), bool))]
        slack = 1e-9 * (1 + lengths) * (1 + np.abs(self.points).max(initial=0) * self.points.shape[1])
        while stack:
            i, cut = stack.pop()
            lo, hi, left, right = self.nodes[i]
            bound = queries @ self.centres[i] + lengths * self.radii[i] + slack
            cut = cut | (bound < floor)
            if left < 0:
                spans.append((lo, hi))
                bounds.append(np.where(cut, -np.inf, bound))
            elif not cut.all():
                stack += [(right, cut), (left, cut)]
        return spans, np.array(bounds).reshape(len(spans), len(queries))


def search(q_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, points: np.ndarray, k: int, scale: int = 1):
    """(query place, candidate place, score) of each query's k best among `points`, own id left out.

    Rows are multiples of 1 / scale, scores exact integers: scale^2 times inner products.
    Only scores of at least `floor` (-inf: none known) are sought.  c_ids ascend, so on
    equal scores the smaller place is the smaller id.  Vectors whose products are exact in
    doubles are searched by the ball tree; the few beyond are compared in whole numbers."""
    limit = math.isqrt(2**53 // max(points.shape[1], 1)) / scale
    small_q, small_c = (np.abs(m).max(axis=1, initial=0) < limit for m in (queries, points))
    found: list[tuple[np.ndarray, np.ndarray, list[int]]] = []

    def whole(qs: np.ndarray, cs: np.ndarray) -> None:
        if not len(qs) or not len(cs):
            return
        exact = integers(points[cs], scale)
        for q in qs.tolist():
            scores = exact.dot(integers(queries[q : q + 1], scale)[0])
            least = float(floor[q])  # Python compares integers of any size with its own floats exactly
            own = [(-s, c) for s, c in zip(scores.tolist(), cs.tolist()) if c_ids[c] != q_ids[q] and s >= least]
            best = heapq.nsmallest(k, own)
            found.append((np.full(len(best), q), np.array([c for _, c in best], np.int64), [-s for s, _ in best]))

    sq, sc = np.flatnonzero(small_q), np.flatnonzero(small_c)
    if len(sq) and len(sc):
        who, place, scores = _tree_search(q_ids[sq], queries[sq] * scale, floor[sq], c_ids[sc], points[sc] * scale, k)
        found.append((sq[who], sc[place], scores.tolist()))
    whole(sq, np.flatnonzero(~small_c))
    whole(np.flatnonzero(~small_q), np.arange(len(points)))
    who = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in found)])
    place = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
    scores = [s for f in found for s in f[2]]
    if len(found) > 1:  # a query's best of both kinds, together
        order = sorted(range(len(who)), key=lambda i: (who[i], -scores[i], place[i]))
        nth, kept, last = 0, [], -1
        for i in order:
            nth = nth + 1 if who[i] == last else 1
            last = who[i]
            if nth <= k:
                kept.append(i)
        who, place, scores = who[kept], place[kept], [scores[i] for i in kept]
    return who, place, scores


def _tree_search(q_ids: np.ndarray, fq: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, fp: np.ndarray, k: int):
    """`search` over rows of whole numbers whose inner products are exact in doubles."""
    tree = BallTree(fp)
    lengths = np.sqrt((fq * fq).sum(axis=1))
    kth = floor.astype(np.float64).copy()
    spans, bounds = tree.leaf_bounds(fq, lengths, kth)
    n, leaves = len(fq), len(spans)
    # A query's best so far: scores (-inf: none) and places, side by side.
    best, where = np.full((n, k), -np.inf), np.full((n, k), len(fp), np.int64)
    turn = np.argsort(np.argsort(-bounds, axis=0, kind="stable"), axis=0, kind="stable")
    lo, step = 0, 1
    while lo < leaves:  # each query's next leaves in the order of its own bounds
        hi = min(leaves, lo + step)
        for leaf in range(leaves):
            who = np.flatnonzero((turn[leaf] >= lo) & (turn[leaf] < hi) & (bounds[leaf] >= kth) & (bounds[leaf] > -np.inf))
            if not len(who):
                continue
            rows = tree.order[spans[leaf][0] : spans[leaf][1]]
            scores = np.rint(fq[who] @ fp[rows].T)
            scores[(q_ids[who][:, None] == c_ids[rows][None, :]) | (scores < kth[who][:, None])] = -np.inf
            merged = np.concatenate([best[who], scores], axis=1)
            places = np.concatenate([where[who], np.broadcast_to(rows, scores.shape)], axis=1)
            # Higher scores first, then smaller places.
            order = np.lexsort((places, -merged), axis=1)[:, :k]
            best[who], where[who] = np.take_along_axis(merged, order, axis=1), np.take_along_axis(places, order, axis=1)
            kth[who] = np.maximum(kth[who], best[who, -1])
        lo, step = hi, step * 2
    who, col = np.nonzero(best > -np.inf)
    return who, where[who, col], best[who, col].astype(np.int64)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    lengths = np.asarray(lists.value_lengths())
    flat = np.asarray(lists.flatten())
    out = np.zeros((len(lists), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def _sort_key(score: int) -> str | None:
    """For scores beyond a long, text in the order of the numbers; null for others."""
    if -(2**63) <= score < 2**63:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):04d}{digits}"
    return f"{9999 - len(digits):04d}" + "".join(chr(ord("9") - ord(c) + ord("0")) for c in digits)


def _as_floor(score: int) -> float:
    """A double that is not above an integer of any size."""
    try:
        return float(np.nextafter(float(score), -np.inf)) if abs(score) >= 2**53 else float(score)
    except OverflowError:
        return float(np.finfo(np.float64).max) if score > 0 else -np.inf


FOUND = "query_id long, vec_id long, side int, size string, score long"


def _searcher(k: int, dim: int, scale: int, keep_kth: bool):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        q_ids = np.asarray(queries["vec_id"])
        floor = np.asarray(queries["kth"].to_numpy(zero_copy_only=False), np.float64)
        floor = np.where(np.isnan(floor), -np.inf, floor)
        c_ids = np.asarray(candidates["vec_id"])
        order = np.argsort(c_ids, kind="stable")
        who, where, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        if len(q_ids) and len(c_ids):
            points = _matrix(candidates["v"], dim)[order]
            who, where, scores = search(q_ids, _matrix(queries["v"], dim), floor, c_ids[order], points, k, scale)
        if keep_kth:
            held, least = np.bincount(who, minlength=len(q_ids)), {}
            for q, s in zip(who.tolist(), scores):
                least[q] = min(s, least.get(q, s))
            kth = [_as_floor(least[q]) if held[q] >= k else None for q in range(len(q_ids))]
            return pa.table({"vec_id": pa.array(q_ids, pa.int64()), "v": queries["v"], "kth": pa.array(kth, pa.float64())})
        keys = [_sort_key(s) for s in scores]
        return pa.table({
            "query_id": pa.array(q_ids[who], pa.int64()), "vec_id": pa.array(c_ids[order][where], pa.int64()),
            "side": pa.array([0 if x is None else 1 if s > 0 else -1 for x, s in zip(keys, scores)], pa.int32()),
            "size": pa.array(keys, pa.string()),
            "score": pa.array([s if x is None else None for x, s in zip(keys, scores)], pa.int64()),
        })

    return run


def _part(name: str, parts: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("int").alias(name)


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
          shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every row whose id `every` divides.

    Ties go to the smaller id.  Fewer candidates than k give fewer rows.  Vectors of
    different lengths are compared as if padded with zeros.  Rows repeated with one id
    are one vector each, none a candidate of that id's query; as queries they are one
    (the least vector).  Rows that `quantised` leaves out take no part; an empty table
    gives no rows.  Components of any finite size are ranked exactly; a score beyond a
    long has its rank and a null in its place.
    """
    # Of rows with one id and one vector, no more than k can be among a query's k best.
    copies = quantised(embeddings, id_col, vector_col, scale).groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    vectors = stored(copies.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("col"), "vectors")
    n, dim = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    asked = vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-n // (every * block_rows)))
    candidates = vectors.withColumn("shard", _part("shard", shards, 1))
    queries = asked.withColumn("block", _part("block", blocks, 2))
    as_long = F.lit(None).cast("double").alias("kth")

    # Home shard: block b asks shard b mod `shards`; each shard is sent to its own blocks only.
    at_home = candidates.filter(F.col("shard") < blocks).withColumn(
        "block", F.explode(F.sequence(F.col("shard"), F.lit(blocks - 1), F.lit(shards)))
    )
    seeded = (
        queries.select("block", "vec_id", "v", as_long).groupBy("block")
        .cogroup(at_home.select("block", "vec_id", "v").groupBy("block"))
        .applyInArrow(_searcher(k, dim, scale, keep_kth=True), "vec_id long, v array<double>, kth double")
    )
    seeded = stored(seeded, "seeded").withColumn("block", _part("block", blocks, 2))

    left = seeded.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).groupBy("block", "shard")
    right = candidates.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("block", "shard")
    found = left.cogroup(right).applyInArrow(_searcher(k, dim, scale, keep_kth=False), FOUND)
    rank = Window.partitionBy("query_id").orderBy(F.col("side").desc(), F.col("size").desc(), F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
