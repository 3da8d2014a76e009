"""Written tables in the shared folder that `spark.checkpoint.dir` names."""

from __future__ import annotations

import contextlib
import threading
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from ..session import delete_folder, write_table

_local = threading.local()


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """`df` written once as Parquet under the shared folder and read back: cuts the
    lineage, survives lost executors, and lets later steps prune columns."""
    path = write_table(df, f"llm-{name}", compression=compression)
    for folders in getattr(_local, "open", []):
        folders.append(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Delete every table that this thread stores inside the block when the block ends.

    What is to outlive it must be written by other means before."""
    folders: list[str] = []
    _local.open = [*getattr(_local, "open", []), folders]
    try:
        yield
    finally:
        _local.open = [x for x in _local.open if x is not folders]
        for path in folders:
            delete_folder(spark, path)
