"""Small helpers for operators that run numpy inside Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_texts(df: DataFrame, per_batch: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text",
              extra: list[Column] | None = None) -> DataFrame:
    """Run `per_batch(state, record_batch) -> record_batch` over (id, text, *extra) rows.

    Only the named columns travel to Python, so further input columns, whatever their
    names, have no effect.  `per_batch` is built by a factory: it is called once per
    task and may keep caches between batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = per_batch()
        for batch in batches:
            for part in bounded(batch):
                yield step(part)

    cols = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(extra or [])]
    return df.select(*cols).mapInArrow(run, schema)


# Texts of one batch are worked on in slices of about this many bytes, so that numpy
# scratch arrays stay small whatever the batch size; one longer text is a slice alone.
SLICE_BYTES = 1 << 20


def bounded(batch: pa.RecordBatch, text_at: int = 1) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of at most SLICE_BYTES of text, or one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)
