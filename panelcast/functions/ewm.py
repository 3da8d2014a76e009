"""Exponentially weighted mean (pandas ``ewm(span).mean()``, adjust=True) without a UDF.

y_p = sum_i q^i x_{p-i} / sum_i q^i with q = 1 - 2/(span+1), both sums over the rows
whose x is not missing (a row without a value keeps the mean so far; before the first
value there is none).  The numerator is a running sum of x_j q^{-j} and the
denominator of q^{-j}, which overflow on long series, so rows are cut into blocks
of B rows (B a power of two with q^B < 1e-18): inside a block the running sum is
rebased at the block start, and the previous block's last numerator is carried in
with weight q^{j+1}, and so is its last denominator.  Terms older than one block weigh
less than q^B and vanish below double precision, unless a whole block has no value.

All of it is window sums over (series, segment, block) partitions, so it stays in the
JVM and never needs a whole series in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EWM_TOLERANCE = 1e-18


def ewm_decay(span: float) -> float:
    if span < 1:
        raise ValueError("span must be >= 1")
    return 1.0 - 2.0 / (span + 1.0)


# q^{-B} times the data must stay finite: keep B * ln(1/q) below this.
MAX_LOG_GROWTH = 600.0


def ewm_block_rows(span: float, preferred: int | None = None) -> int:
    """Block length B: a power of two with q^B < EWM_TOLERANCE and q^-B finite.

    Returns `preferred` (the layout's shared block) whenever it satisfies both, so that
    every EWM shares one sort order; otherwise the smallest valid power of two >= 64.
    """
    q = ewm_decay(span)
    if q <= 0.0:
        return 64
    need = math.log(EWM_TOLERANCE) / math.log(q)
    growth = -math.log(q)
    if preferred and preferred >= need and preferred * growth <= MAX_LOG_GROWTH:
        return preferred
    b = 64
    while b < need:
        b *= 2
    if b * growth > MAX_LOG_GROWTH:
        raise ValueError(f"no block length suits span {span}")
    return b


def with_ewms(
    df: DataFrame,
    specs: list[tuple[str, float, str]],
    partition: list[str],
    order: str,
    pos: str,
    shared_block: tuple[str | None, int],
    max_rows: int | None = None,
    alongside: dict | None = None,
) -> DataFrame:
    """Add one column per (x, span, out) = EWM(span) of column x.

    `partition` are the series partition columns, `pos` the 0-based row number of the
    row within its whole series (not within a segment).  `shared_block` names the
    layout's block column and its length (= the halo length); it is used whenever the
    span allows, so all EWMs and the other windows share one sort.  Rows of a
    partition cover whole blocks except at the start, which is either the series
    start or a halo of whole blocks (see operators.series).  Independent EWMs given
    together share their two window levels (block sums, then block carries).  When
    every series is known to fit in one block (`max_rows` from the layout's count) the
    carry level is skipped: there is no previous block.  `alongside` columns are added in
    the same projection as the block sums, so window expressions with the same spec
    are evaluated in the same window operator.
    """
    shared_name, shared_rows = shared_block
    p = F.col(pos)
    plans = []
    for x, span, out in specs:
        q = ewm_decay(span)
        if q == 0.0:
            df = df.withColumn(out, F.col(x).cast("double"))
            continue
        whole = max_rows is not None and max_rows <= shared_rows
        if whole and shared_rows * -math.log(q) <= MAX_LOG_GROWTH:
            # Every series is one block: exact, nothing truncated, no block column.
            plans.append((x, q, shared_rows, out, shared_name))
            continue
        if shared_name is None:
            shared_name = "_blk_shared"
        b = ewm_block_rows(span, shared_rows)
        if b > shared_rows:
            raise ValueError(f"span {span} needs {b}-row blocks; the layout halo holds {shared_rows}")
        blk = shared_name if b == shared_rows else f"_{out}_blk"
        if blk not in df.columns:
            df = df.withColumn(blk, F.floor(p / b).cast("long"))
        plans.append((x, q, b, out, blk))
    if not plans:
        return df.withColumns(alongside) if alongside else df

    def j(b, blk):
        return p.cast("double") if blk is None else (p - F.col(blk) * b).cast("double")

    # The powers are columns below the window: above it every use would compute them again.
    powers = {}
    for _, q, b, out, blk in plans:
        powers |= {f"_{out}_back": F.pow(F.lit(q), j(b, blk)), f"_{out}_grow": F.pow(F.lit(q), -j(b, blk))}
    df = df.withColumns(powers)
    local = {}
    for x, q, b, out, blk in plans:
        part = list(partition) if blk is None else [*partition, blk]
        inside = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        back, grow = F.col(f"_{out}_back"), F.col(f"_{out}_grow")
        held = F.when(F.col(x).isNotNull(), grow)
        local[f"_{out}_loc"] = back * F.coalesce(F.sum(F.col(x) * grow).over(inside), F.lit(0.0))
        local[f"_{out}_den"] = back * F.coalesce(F.sum(held).over(inside), F.lit(0.0))
    df = df.withColumns({**(alongside or {}), **local})
    final = {}
    for x, q, b, out, blk in plans:
        num, den = F.col(f"_{out}_loc"), F.col(f"_{out}_den")
        if not (blk is None or (max_rows is not None and max_rows <= b)):
            prev_block = Window.partitionBy(*partition).orderBy(blk).rangeBetween(-1, -1)
            earlier = F.pow(F.lit(q), j(b, blk) + 1)
            # The last row of the previous block holds the sums over all of it.
            num, den = (
                here + earlier * F.coalesce(F.max_by(here, p).over(prev_block), F.lit(0.0)) for here in (num, den)
            )
        final[out] = F.when(den > 0, num / den)
    df = df.withColumns(final).drop(*local, *powers)
    own = {blk for *_, blk in plans if blk is not None and blk != shared_block[0]}
    return df.drop(*own) if own else df


def with_ewm(df, x, span, out, partition, order, pos, shared_block, max_rows=None, alongside=None) -> DataFrame:
    """Single-column form of with_ewms."""
    return with_ewms(df, [(x, span, out)], partition, order, pos, shared_block, max_rows, alongside)
