"""Physical layout of a panel of time series for window operators.

Every per-series window in this package is partitioned by (key, _seg).  The first
level (row numbers, lags, leads) is ordered by time.  If every series fits in one EWM
block (<= 2,048 rows, from the per-key count) every later level is ordered by time too:
one sort serves all.  Otherwise later levels are ordered by (_blk, time), the same
order, so the EWM block windows (partitioned by _blk) share that second sort.  A series
of at most `segment_rows` rows is one segment (_seg = 0), so the common case is a
single hash exchange on the key.

A *long* series - e.g. one ticker holding a third of all rows - is split so that it
never lands in one task:

1. rows get their global position _pos: per (key, time bucket) counts -> running
   offsets over that small table -> offset + row_number inside the bucket;
2. _seg = _pos div segment_rows;
3. the last `halo_rows` rows of segment s are copied into segment s+1 and the first
   row of segment s+1 into segment s, flagged _halo, so look-back windows (<= halo
   rows) and the one-row look-ahead of the target see exactly the rows they would
   see on the whole series.  Halo copies are removed by SeriesFrame.finish().

Unbounded look-backs (forward fill) add a per-segment carry, see operators.indices.
Which series are long is decided from a per-key count, an aggregate whose size is one
row per key; the list of long keys is broadcast only below `broadcast_limit`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare_session

LAYOUT_COLUMNS = ["_seg", "_pos", "_blk", "_halo"]
SINGLE_BLOCK_MAX = 2048  # longest series handled as one EWM block (q^-B stays finite)


@dataclass(frozen=True)
class SeriesLayout:
    key: str = "Ticker"
    order: str = "Date"
    segment_rows: int = 1 << 17
    halo_rows: int = 1024
    bucket: str = "month"
    broadcast_limit: int = 2_000_000
    # Rows of a window task; its work follows rows, not bytes.  Every task generates its
    # projections anew, so once there are two tasks a core they get more rows, up to the most.
    task_rows: int = 50_000
    most_task_rows: int = 400_000

    def __post_init__(self):
        if self.halo_rows < 64 or self.halo_rows & (self.halo_rows - 1):
            raise ValueError("halo_rows must be a power of two >= 64")
        if self.segment_rows % self.halo_rows or self.segment_rows < 2 * self.halo_rows:
            raise ValueError("segment_rows must be a multiple of halo_rows and >= 2 * halo_rows")


@dataclass(frozen=True)
class SeriesFrame:
    """A panel DataFrame plus its layout columns (_seg, _pos, _halo)."""

    df: DataFrame
    layout: SeriesLayout
    segmented: bool = False
    positioned: bool = False
    max_rows: int | None = None  # longest series, from the layout's per-key count

    def window(self):
        """The per-series window.  Ordering by (_blk, time) equals ordering by time, and
        lets the EWM block windows (partitioned by _blk) share the same sort; with a
        single block there is no block column in any window, so one sort serves all."""
        if self.single_block:
            return Window.partitionBy(self.layout.key, "_seg").orderBy(self.layout.order)
        return Window.partitionBy(self.layout.key, "_seg").orderBy("_blk", self.layout.order)

    def ewm_block(self) -> tuple[str | None, int]:
        """(block column, block length) for functions.ewm; no column for a single block."""
        return (None, self.block_rows) if self.single_block else ("_blk", self.layout.halo_rows)

    def with_positions(self) -> "SeriesFrame":
        """Fill _pos (row number in the whole series) and _blk = _pos div halo_rows."""
        if self.positioned:
            return self
        w = Window.partitionBy(self.layout.key, "_seg").orderBy(self.layout.order)
        d = self.df.withColumn("_pos", F.coalesce(F.col("_pos"), (F.row_number().over(w) - 1).cast("long")))
        d = d.withColumn("_blk", self.block_id())
        return replace(self, df=d, positioned=True)

    @property
    def single_block(self) -> bool:
        """True when no series is split and the longest fits in one EWM block: the block
        id is then the literal 0, which the planner folds out of every sort order."""
        return (not self.segmented) and self.max_rows is not None and self.max_rows <= SINGLE_BLOCK_MAX

    @property
    def block_rows(self) -> int:
        """EWM block length: the halo length, or one block covering every series."""
        if not self.single_block:
            return self.layout.halo_rows
        b = 64
        while b < self.max_rows:
            b *= 2
        return max(b, 64)

    def block_id(self):
        if self.single_block:
            return F.lit(0).cast("long")
        return F.floor(F.col("_pos") / self.layout.halo_rows).cast("long")

    def with_df(self, df: DataFrame) -> "SeriesFrame":
        return replace(self, df=df)

    def finish(self) -> DataFrame:
        """Drop halo copies and layout columns."""
        return self.df.filter(~F.col("_halo")).drop(*LAYOUT_COLUMNS)


def window_tasks(rows: int, layout: SeriesLayout, spark) -> int:
    """Tasks of the window stage: of `task_rows` rows each up to two tasks a core, beyond that whole
    rounds of all cores, as few as keep every task below `most_task_rows` rows."""
    tasks = lambda n: max(1, -(-rows // n))
    try:
        cores = int(spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001 - no SparkContext handle (e.g. a remote session)
        return tasks(layout.task_rows)
    rounds = max(2, -(-tasks(layout.most_task_rows) // cores))
    return min(tasks(layout.task_rows), rounds * cores)


def layout_series(df: DataFrame, layout: SeriesLayout | None = None) -> SeriesFrame:
    prepare_session(df.sparkSession)
    layout = layout or SeriesLayout()
    key, order = layout.key, layout.order
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    long_keys = counts.filter(F.col("_n") > layout.segment_rows).select(key)
    # One small job: how many series need splitting, how long the longest is, and all rows.
    n_long, max_rows, n_rows = counts.agg(
        F.coalesce(F.sum((F.col("_n") > layout.segment_rows).cast("long")), F.lit(0)), F.max("_n"), F.sum("_n")
    ).first()
    # The one exchange of the windows, with tasks by rows: adaptive execution would join the
    # small partitions of a narrow table to about as many tasks as cores, of uneven work.
    # A panel of one task is left to the planner.
    tasks = window_tasks(n_rows or 0, layout, df.sparkSession)
    deal = lambda d, *by: d.repartition(tasks, *by) if tasks > 1 else d
    if n_long == 0:
        out = df.withColumns(
            {"_seg": F.lit(0).cast("long"), "_pos": F.lit(None).cast("long"), "_halo": F.lit(False)}
        )
        return SeriesFrame(deal(out, key), layout, segmented=False, max_rows=max_rows or 0)

    keys = F.broadcast(long_keys) if n_long <= layout.broadcast_limit else long_keys
    # Positions of short series are numbered after the union, inside the main exchange.
    short = df.join(keys, key, "left_anti").withColumns(
        {"_seg": F.lit(0).cast("long"), "_pos": F.lit(None).cast("long"), "_halo": F.lit(False)}
    )
    long_rows = df.join(keys, key, "left_semi").withColumn("_bkt", F.date_trunc(layout.bucket, F.col(order)))
    per_bucket = long_rows.groupBy(key, "_bkt").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(key).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(key, "_bkt", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    in_bucket = Window.partitionBy(key, "_bkt").orderBy(order)
    s, h = layout.segment_rows, layout.halo_rows
    positioned = long_rows.join(offsets, [key, "_bkt"]).withColumn(
        "_pos", (F.col("_off") + F.row_number().over(in_bucket) - 1).cast("long")
    )
    seg = F.floor(F.col("_pos") / s).cast("long")
    r = F.col("_pos") - seg * s
    copies = F.filter(
        F.array(
            F.struct(seg.alias("s"), F.lit(False).alias("h")),
            F.when(r >= s - h, F.struct((seg + 1).alias("s"), F.lit(True).alias("h"))),
            F.when((r == 0) & (seg > 0), F.struct((seg - 1).alias("s"), F.lit(True).alias("h"))),
        ),
        lambda c: c.isNotNull(),
    )
    long_out = (
        positioned.withColumn("_copy", F.explode(copies))
        .withColumns({"_seg": F.col("_copy.s"), "_halo": F.col("_copy.h")})
        .drop("_copy", "_bkt", "_off")
    )
    return SeriesFrame(deal(short.unionByName(long_out), key, "_seg"), layout, segmented=True)


def as_series(
    data: DataFrame | SeriesFrame, layout: SeriesLayout | None = None, positioned: bool = True
) -> SeriesFrame:
    """A SeriesFrame (lays out a plain DataFrame first), positioned unless asked not to."""
    sf = data if isinstance(data, SeriesFrame) else layout_series(data, layout)
    return sf.with_positions() if positioned else sf
