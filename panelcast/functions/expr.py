"""Column-expression helpers with pandas missing-value semantics.

Missing values are SQL nulls throughout.  The reference's NaN rules are mapped as
follows: 0/0 -> null (the row is later dropped), x/0 -> +-inf (kept, later set to
0), a rolling statistic is null until its frame holds N non-missing values.
Everything here is a plain Catalyst expression, so it stays inside codegen /
WindowExec and never calls Python per row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")

# Relative nudge applied before decimal rounding, so that values whose exact decimal
# expansion ends on a tie round the same way in every engine (see stable_round).
ROUND_BIAS = 1.0 + 2.0**-40


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(n: str | Column, d: str | Column) -> Column:
    """n / d with IEEE results but no ANSI error: x/0 -> +-inf, 0/0 and nulls -> null."""
    n, d = col(n), col(d)
    return (
        F.when(d != 0, n / d)
        .when((d == 0) & (n > 0), F.lit(INF))
        .when((d == 0) & (n < 0), F.lit(-INF))
    )


def rows_frame(w: WindowSpec, n: int, end: int = 0) -> WindowSpec:
    """The n rows ending `end` rows from the current one."""
    return w.rowsBetween(end - (n - 1), end)


def roll(fn, x: str | Column, n: int, w: WindowSpec, end: int = 0) -> Column:
    """pandas rolling(n).<fn>() : defined only when the frame holds n non-missing values."""
    x = col(x)
    frame = rows_frame(w, n, end)
    return F.when(F.count(x).over(frame) == n, fn(x).over(frame))


def lagged(x: str, n: int, w: WindowSpec, start: int = 1) -> dict[str, Column]:
    """Columns _<x>_<k>: the values of `x` k rows earlier, start <= k <= n.  Each costs a row one
    look, where a sliding frame is gone through again for every row."""
    return {f"_{x}_{k}": F.lag(x, k).over(w) for k in range(start, n + 1)}


def total(values: list[Column]) -> Column:
    """Their sum; missing unless every one is there."""
    return reduce(lambda a, b: a + b, values)


def leading(there: list[Column]) -> Column:
    """How many of the conditions hold before the first that does not."""
    return F.coalesce(*[F.when(~c, F.lit(k)) for k, c in enumerate(there)], F.lit(len(there)))


def mean_of(values: list[Column]) -> Column:
    """Rolling mean of the row's `values`: defined only when none is missing."""
    return total(values) / len(values)


def centre_of(values: list[Column]) -> Column:
    """Their mean by differences from the first, so that equal values leave no rounding error."""
    return values[0] + total([v - values[0] for v in values[1:]]) / len(values)


def squares_about(values: list[Column], centre: Column) -> Column:
    """Sum of the squared distances from `centre` (the second pass of a two-pass variance)."""
    return total([(v - centre) * (v - centre) for v in values])


HELD = "_held"


def held_aside(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and all others as one struct, which a window or join that does not need
    them copies in one piece instead of column by column.  `given_back` is the inverse."""
    rest = [c for c in df.columns if c not in set(keep)]
    return df.select(*[c for c in df.columns if c in set(keep)], F.struct(*rest).alias(HELD)) if rest else df


def given_back(df: DataFrame, columns: list[str]) -> DataFrame:
    """The given columns, those set aside by `held_aside` out of their struct."""
    there = set(df.columns)
    return df.select(*[F.col(c) if c in there else F.col(HELD).getField(c).alias(c) for c in columns])


def extreme_of(fn, values: list[Column]) -> Column:
    """F.greatest or F.least of the row's `values`: defined only when none is missing."""
    return F.when(reduce(lambda a, b: a & b, [v.isNotNull() for v in values]), fn(*values))


def finite_or_zero(x: str | Column) -> Column:
    """null, NaN, +-inf -> 0.0 (numpy.nan_to_num with all replacements 0)."""
    x = col(x)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(INF)), F.lit(0.0)).otherwise(x)


def clean(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """P11 + P12 + P13: replace missing and infinite values by 0 in numeric columns."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    targets = [c for c in (columns if columns is not None else df.columns) if c in numeric]
    return df.withColumns({c: finite_or_zero(c) for c in targets}) if targets else df


def stable_round(x: str | Column, digits: int) -> Column:
    """Decimal rounding that agrees across engines.

    The value is nudged by a relative 2**-40 (far above summation noise, far below
    the rounding step) so exact decimal ties do not depend on the last ulp, and -0.0
    is folded to 0.0.  `oracle.rnd` writes the same expression in SQL.
    """
    v, scale = col(x) * F.lit(ROUND_BIAS), float(10**digits)
    # Whole steps counted in a long: exact below 2^52 of them.  F.round goes through a decimal
    # text for every value, many times as long; it is left the others (also NaN, infinity).
    steps = F.floor(F.abs(v) * scale + 0.5) / F.lit(scale)
    r = F.when(F.abs(v) * scale < 2.0**52, F.when(v < 0, -steps).otherwise(steps)).otherwise(F.round(v, digits))
    return F.when(r == 0, F.lit(0.0)).otherwise(r)
