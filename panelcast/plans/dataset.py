"""Entry A: bars -> technical -> lag -> index features -> stored panel, one lazy plan.

One hash exchange on Ticker (plus the segment split for long series), one broadcast of
the calendar-sized index table; only the sink touches disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.indices import index_features, join_index_features, wide_index_table
from ..operators.lags import lag_features
from ..operators.series import SeriesLayout
from ..operators.technical import technical_features
from ..sources.files import write_panel


def build_panel(
    bars: DataFrame,
    index_bars: DataFrame | None = None,
    layout: SeriesLayout | None = None,
    index_names: list[str] | None = None,
    index_lag_days: int = 0,
    drop_warmup: bool = False,
) -> DataFrame:
    """The full feature panel: 49 technical + 21 lag + 6 per index."""
    sf = lag_features(technical_features(bars, layout), drop_warmup=drop_warmup)
    if index_bars is not None:
        wide = wide_index_table(index_features(index_bars), index_names, index_lag_days)
        sf = join_index_features(sf, wide)
    return sf.finish()


def build_and_write(bars: DataFrame, index_bars: DataFrame | None, path: str, **kw) -> None:
    write_panel(build_panel(bars, index_bars, **kw), path)
