"""V1, V2: a user's own Python functions over the rows of each series.

The built-in windows stay in the JVM and should be preferred.  What they cannot express
runs here, once for each (key, _seg) slice of the layout instead of once for each series:
a slice holds at most `segment_rows` rows and its halo, so a long series is many tasks
and no task holds a whole one.  The slices are those of the window operators, so a stage
that follows them needs no further exchange.  Rows pass through as Arrow columns; only
the columns a function asks for become pandas or numpy values, and null and undefined
results come back as nulls.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .series import SeriesFrame, SeriesLayout, as_series

WINDOWS_AT_ONCE = 16_384  # windows handed to a rolling function in one array


def layout_for(look_back: int, layout: SeriesLayout | None = None) -> SeriesLayout:
    """`layout` with a halo of at least `look_back` rows."""
    layout = layout or SeriesLayout()
    halo = layout.halo_rows
    while halo < look_back:
        halo *= 2
    segment = -(-max(layout.segment_rows, 2 * halo) // halo) * halo
    return replace(layout, halo_rows=halo, segment_rows=segment)


def _sliced(data: DataFrame | SeriesFrame, look_back: int) -> SeriesFrame:
    if look_back < 0:
        raise ValueError("look_back must not be negative")
    if not isinstance(data, SeriesFrame):
        return as_series(data, layout_for(look_back))
    if data.segmented and look_back > data.layout.halo_rows:
        raise ValueError("the layout's halo is shorter than look_back; lay the rows out with layout_for(look_back)")
    return as_series(data)


def _returned(sf: SeriesFrame, returns: dict[str, T.DataType | str]) -> T.StructType:
    """The frame's columns and the new ones; a new name that is taken is an error."""
    taken = sorted(set(returns) & set(sf.df.columns))
    if taken:
        raise ValueError(f"columns exist already: {taken}")
    fields = list(sf.df.schema.fields)
    for name, kind in returns.items():
        fields.append(T.StructField(name, T.DataType.fromDDL(kind) if isinstance(kind, str) else kind, True))
    return T.StructType(fields)


def apply_to_slices(
    data: DataFrame | SeriesFrame, function: Callable, needs: list[str], returns: dict[str, T.DataType | str], look_back: int,
) -> SeriesFrame:
    """V1: new columns by `function(rows)` on the rows of each slice.

    `rows` is a pandas frame of the columns `needs` in time order; the function returns a
    mapping or frame of the columns `returns` (name -> type), one value a row.  A value
    may depend on up to `look_back` rows before its own, counted along a chain of
    operators; more rows may be there, so it must not depend on where the slice begins.
    A plain frame is laid out with a halo of that length.  No rows give no rows.
    """
    sf = _sliced(data, look_back)
    schema, names = _returned(sf, returns), list(returns)

    def step(table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        table = table.sort_by("_pos")
        found = function(table.select(needs).to_pandas())
        for name in names:
            values = found[name]
            if len(values) != table.num_rows:
                raise ValueError(f"{name}: {len(values)} values for {table.num_rows} rows")
            kind = to_arrow_type(schema[name].dataType)
            table = table.append_column(name, pa.array(values, kind, from_pandas=True))
        return table

    return sf.with_df(sf.df.groupBy(sf.layout.key, "_seg").applyInArrow(step, schema))


def rolling_apply(
    data: DataFrame | SeriesFrame, column: str, window: int, functions: dict[str, Callable],
) -> SeriesFrame:
    """V2: rolling(window).apply of user functions over one numeric column.

    Each function takes an array of shape (windows, window), oldest value first, and
    returns one value a window; it sees only windows without missing or infinite values,
    `WINDOWS_AT_ONCE` at a time.  Rows whose window is not full or holds such a value get
    null, and so do undefined results.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    at_once = WINDOWS_AT_ONCE

    def roll(rows):
        import numpy as np

        x = rows[column].to_numpy(dtype=float, na_value=np.nan)
        out = {name: np.full(len(x), np.nan) for name in functions}
        if len(x) >= window:
            every = np.lib.stride_tricks.sliding_window_view(x, window)
            missing = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
            whole = np.flatnonzero(missing[window:] == missing[:-window])
            for i in range(0, len(whole), at_once):
                at = whole[i : i + at_once]
                part = every[at]
                for name, f in functions.items():
                    out[name][at + window - 1] = f(part)
        return out

    return apply_to_slices(data, roll, [column], dict.fromkeys(functions, "double"), window - 1)
