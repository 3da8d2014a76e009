"""Time-ordered folds as a small definition table plus filters.

A fold is four dates (train_end, val_start, val_end, plus the implicit series start);
train = Date <= train_end, validation = val_start <= Date <= val_end.  No rows are
copied: `fold_frames` returns two filters over the (materialised) panel, which reach
the Parquet scan as pushed predicates.

The split summary reads the panel once: every row is tagged with the interval
between consecutive fold boundary dates and aggregated per (Ticker, interval) with
map-side partial aggregation, a table of at most tickers x (3 n + 1) rows.  All fold
metrics (ranges, rows, distinct tickers) come from that small table joined with the
broadcast fold ranges (n rows).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUMMARY_COLUMNS = [
    "fold", "train_start", "train_end", "val_start", "val_end",
    "train_samples", "val_samples", "train_stocks", "val_stocks",
]


DAY_MICROS = 24 * 60 * 60 * 1_000_000


def _day_or_micros(date: Column, kind: T.DataType) -> Column:
    """A long in the order of the dates: days, or microseconds of a timestamp."""
    if isinstance(kind, T.DateType):
        return F.unix_date(date).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(date)
    second = (F.extract(F.lit("SECOND"), date) * 1_000_000).cast("long")
    minutes = F.hour(date).cast("long") * 60 + F.minute(date)
    return F.unix_date(F.to_date(date)).cast("long") * DAY_MICROS + minutes * 60_000_000 + second


class Calendar:
    """The sorted distinct dates (or timestamps) of a panel, found by their place.

    Places come from counting in two or more levels, never from one window over all dates.
    The first level counts the dates of each span of 31 days, at most about 118,000 numbers
    whatever the panel holds.  A span that holds more than `most` dates (timestamps within a
    day) is counted again by hour, minute and second, but only where a wanted place lies.
    Null dates take no place; an empty panel has size 0.
    """

    def __init__(self, panel: DataFrame, date: str = "Date", most: int = 1_000_000):
        self.kind = panel.schema[date].dataType
        in_days = isinstance(self.kind, T.DateType)
        self.spans = [31] if in_days else [31 * DAY_MICROS, 3_600_000_000, 60_000_000, 1_000_000]
        self.date, self.most = date, most
        at = _day_or_micros(F.col(date), self.kind)
        self.dates = panel.select(date).filter(F.col(date).isNotNull()).distinct().withColumn("_at", at)
        self.counts = self._count(self.dates, self.spans[0])
        self.size = sum(self.counts.values())

    @staticmethod
    def _start(span: int) -> Column:
        return F.col("_at") - F.pmod(F.col("_at"), F.lit(span))

    def _count(self, dates: DataFrame, span: int) -> dict[int, int]:
        counted = dates.groupBy(self._start(span).alias("_from")).agg(F.count(F.lit(1)).alias("n")).collect()
        return {r["_from"]: r["n"] for r in sorted(counted)}

    def at(self, places) -> dict:
        """The dates at the given places (from 0); one literal a place goes into the plan."""
        wanted = sorted(set(places))
        if not wanted:
            return {}
        # place -> (start of its span, place within the span)
        found, span, counts = _locate(self.counts, wanted), self.spans[0], self.counts
        for finer in self.spans[1:]:
            if max(counts[start] for start, _ in found.values()) <= self.most:
                break
            refined, all_counts = {}, {}
            for start in sorted({start for start, _ in found.values()}):
                inside = self._count(self.dates.filter(F.col("_at").between(start, start + span - 1)), finer)
                here = {rank: place for place, (s, rank) in found.items() if s == start}
                refined |= {here[rank]: spot for rank, spot in _locate(inside, sorted(here)).items()}
                all_counts |= inside
            found, span, counts = refined, finer, all_counts
        starts = [start for start, _ in found.values()]
        ranked = self.dates.withColumn("_from", self._start(span)).filter(F.col("_from").isin(starts))
        rank = F.row_number().over(Window.partitionBy("_from").orderBy("_at")) - 1
        hit = reduce(lambda a, b: a | b, [(F.col("_from") == s) & (F.col("_rank") == r) for s, r in set(found.values())])
        dates = {(r["_from"], r["_rank"]): r[self.date] for r in ranked.withColumn("_rank", rank).filter(hit).collect()}
        return {place: dates[spot] for place, spot in found.items()}


def _locate(counts: dict[int, int], places: list[int]) -> dict[int, tuple[int, int]]:
    """place -> (span, place within it), for ascending places and spans in order."""
    found, before, spans = {}, 0, iter(counts.items())
    start, n = next(spans)
    for place in places:
        while place >= before + n:
            before += n
            start, n = next(spans)
        found[place] = (start, place - before)
    return found


def trading_calendar(panel: DataFrame, date: str = "Date") -> DataFrame:
    """Distinct dates with their 0-based index.

    A date's index is the number of dates in earlier spans (a table of at most 118,000 rows,
    broadcast) plus its place within its span."""
    cal = Calendar(panel, date)
    before, rows = 0, []
    for start, n in cal.counts.items():
        rows.append((start, before))
        before += n
    offsets = F.broadcast(panel.sparkSession.createDataFrame(rows, "_from long, _before long"))
    within = F.row_number().over(Window.partitionBy("_from").orderBy("_at")) - 1
    ranked = cal.dates.withColumn("_from", Calendar._start(cal.spans[0])).withColumn("_within", within)
    return ranked.join(offsets, "_from").select(date, (F.col("_before") + F.col("_within")).alias("idx"))


@dataclass(frozen=True)
class EqualSplitPlan:
    n_dates: int
    test_days: int
    fold_days: int
    folds: list[tuple[int, int, int, int]]

    @property
    def test_start_idx(self) -> int | None:
        """First test date index; None when the test period is empty (Q6)."""
        return self.n_dates - self.test_days if self.test_days > 0 else None


def plan_equal_splits(n_dates: int, n_splits: int = 5, test_fraction: float = 0.2) -> EqualSplitPlan:
    """K1 positions: fold k validates on the k-th stretch of fold_days dates after the first
    and trains on all dates before it; positions are held inside the calendar.

    A calendar too short for a single validation date per fold (fold_days 0) gives no
    folds: there is nothing to validate on."""
    test_days = math.floor(n_dates * test_fraction)
    fold_days = (n_dates - test_days) // n_splits
    if fold_days == 0:
        return EqualSplitPlan(n_dates, test_days, 0, [])
    inside = lambda i: max(0, min(i, n_dates - 1))
    starts = range(fold_days, (n_splits + 1) * fold_days, fold_days)
    folds = [(k, inside(at - 1), inside(at), inside(at + fold_days - 1)) for k, at in enumerate(starts, 1)]
    return EqualSplitPlan(n_dates, test_days, fold_days, folds)


def equal_split_folds(
    panel: DataFrame, n_splits: int = 5, test_fraction: float = 0.2
) -> tuple[DataFrame, EqualSplitPlan]:
    """K1: (fold, train_end, val_start, val_end) for equal-size expanding folds.

    The number of dates and the three dates of each fold reach the driver, no more.
    """
    cal = Calendar(panel)
    plan = plan_equal_splits(cal.size, n_splits, test_fraction)
    dates = cal.at(i for fold in plan.folds for i in fold[1:])
    names = ["train_end", "val_start", "val_end"]
    schema = T.StructType([T.StructField("fold", T.LongType()), *[T.StructField(n, cal.kind) for n in names]])
    rows = [(k, *[dates[i] for i in places]) for k, *places in plan.folds]
    return panel.sparkSession.createDataFrame(rows, schema), plan


def calendar_split_folds(panel: DataFrame, train_years: int = 6, val_months: int = 6, n_splits: int = 5) -> DataFrame:
    """K3: validation windows of `val_months` after `train_years`; train = Date < val_start.

    Dates step by calendar months with end-of-month clamping applied step by step
    (years first, then k * val_months), as pandas DateOffset does.  Folds whose
    validation window ends after the last date are skipped (P16).
    """
    spark = panel.sparkSession
    lo, hi = panel.agg(F.min("Date"), F.max("Date")).first()  # two scalars
    if lo is None:
        return spark.createDataFrame([], "fold long, train_end date, val_start date, val_end date")
    k = F.col("id")
    vs = F.add_months(F.add_months(F.lit(lo), 12 * train_years), k.cast("int") * val_months)
    return (
        spark.range(0, n_splits)
        .withColumn("val_start", vs)
        .withColumn("val_end", F.date_sub(F.add_months(F.col("val_start"), val_months), 1))
        .filter(F.col("val_end") <= F.lit(hi))
        .select(
            (k + 1).alias("fold"),
            F.date_sub(F.col("val_start"), 1).alias("train_end"),
            "val_start",
            "val_end",
        )
    )


def interval_stats(panel: DataFrame, boundaries: list, key: str = "Ticker") -> DataFrame:
    """Rows per (key, interval) where interval = number of boundary dates <= Date.

    One pass with map-side partial aggregation; the result has at most
    keys x (len(boundaries) + 1) rows.
    """
    iv = F.lit(0)
    for b in boundaries:
        iv = iv + (F.col("Date") >= F.lit(b)).cast("int")
    return (
        panel.select(key, "Date")
        .withColumn("iv", iv)
        .groupBy(key, "iv")
        .agg(F.count(F.lit(1)).alias("n"), F.min("Date").alias("first"), F.max("Date").alias("last"))
    )


def split_summary(panel: DataFrame, folds: DataFrame, min_val_rows: int = 1000, key: str = "Ticker") -> DataFrame:
    """A8 + P15: per fold the train / validation date range, rows and tickers.

    Folds whose validation window holds fewer than `min_val_rows` rows are dropped.
    The result doubles as the fold table of the kept folds (its dates select exactly
    the same rows as the definition).
    """
    import datetime as _dt

    spark = panel.sparkSession
    defs = sorted(folds.collect(), key=lambda r: r["fold"])  # at most n_splits rows
    if not defs:
        return spark.createDataFrame([], summary_schema())
    one = _dt.timedelta(days=1)
    bounds = sorted({d for r in defs for d in (r["train_end"] + one, r["val_start"], r["val_end"] + one)})

    def iv(d) -> int:
        return sum(1 for b in bounds if b <= d)

    ranges = [(int(r["fold"]), iv(r["train_end"] + one), iv(r["val_start"]), iv(r["val_end"] + one)) for r in defs]
    stats = interval_stats(panel, bounds, key)

    def side(cond, prefix: str) -> DataFrame:
        # Each (key, interval) row goes to the folds it belongs to: at most n_splits literals.
        folds_of = F.array(*[F.when(cond(*r[1:]), F.lit(r[0]).cast("long")) for r in ranges])
        picked = stats.withColumn("fold", F.explode(F.filter(folds_of, lambda f: f.isNotNull())))
        per_key = picked.groupBy("fold", key).agg(
            F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")
        )
        return per_key.groupBy("fold").agg(
            F.min("first").alias(f"{prefix}_start"),
            F.max("last").alias(f"{prefix}_end"),
            F.sum("n").alias(f"{prefix}_samples"),
            F.count(F.lit(1)).alias(f"{prefix}_stocks"),
        )

    train = side(lambda train_hi, lo, hi: F.col("iv") < train_hi, "train")
    val = side(lambda train_hi, lo, hi: (F.col("iv") >= lo) & (F.col("iv") < hi), "val")
    out = train.join(val, "fold").select(*SUMMARY_COLUMNS)
    return out.filter(F.col("val_samples") >= min_val_rows) if min_val_rows > 0 else out


def summary_schema() -> str:
    return (
        "fold long, train_start date, train_end date, val_start date, val_end date, "
        "train_samples long, val_samples long, train_stocks long, val_stocks long"
    )


def final_test_start(panel: DataFrame, test_fraction: float = 0.2):
    """K2: first date of the final test period, or None when it is empty (Q6)."""
    cal = Calendar(panel)
    start = plan_equal_splits(cal.size, 1, test_fraction).test_start_idx
    return None if start is None else cal.at([start])[start]


def final_test_frame(panel: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    start = final_test_start(panel, test_fraction)
    return panel.limit(0) if start is None else between_dates(panel, lo=start)


def between_dates(panel: DataFrame, lo=None, hi=None) -> DataFrame:
    """Rows from `lo` to `hi`, both included; a panel stored by year is pruned by year."""
    by_year = "year" in panel.columns
    for bound, of in ((lo, "ge"), (hi, "le")):
        if bound is None:
            continue
        date, limit = F.col("Date"), F.lit(bound)
        panel = panel.filter(date >= limit if of == "ge" else date <= limit)
        if by_year:
            panel = panel.filter(F.col("year") >= bound.year if of == "ge" else F.col("year") <= bound.year)
    return panel


def with_test_overlap(summary: DataFrame, test_start) -> DataFrame:
    """Q5: a split summary with `overlaps_test`: does the validation window reach into the test period?"""
    overlaps = F.lit(False) if test_start is None else F.col("val_end") >= F.lit(test_start)
    return summary.withColumn("overlaps_test", overlaps)


def fold_frames(panel: DataFrame, folds: DataFrame, k: int, exclude_test_from=None) -> tuple[DataFrame, DataFrame]:
    """(train, validation) of fold k as filters; raises if the fold does not exist."""
    row = folds.filter(F.col("fold") == k).first()
    if row is None:
        raise KeyError(f"fold {k} is not in the fold table")
    train = between_dates(panel, hi=row["train_end"])
    val = between_dates(panel, lo=row["val_start"], hi=row["val_end"])
    if exclude_test_from is not None:  # Q5 option: keep validation out of the test period
        val = val.filter(F.col("Date") < F.lit(exclude_test_from))
    return train, val
