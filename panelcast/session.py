"""Session helpers: a local session for tests / bench, and shared scratch space.

Library code never creates a session; it takes the caller's.  Materialised
intermediates go under the cluster's `spark.checkpoint.dir` (a shared folder), never
a machine-local temporary directory.
"""

from __future__ import annotations

import hashlib
import os
import re
import threading
import uuid
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "panelcast") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.constraintPropagation.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Python workers of local runs import this package from where it lies.
    spark.sparkContext.environment["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    return spark


# Wide feature plans (about 100 derived columns behind a 55-column null filter) make
# Catalyst's constraint propagation grow without bound (it rewrites every inferred
# constraint for every alias).  It only feeds inferred filters, which these plans do
# not need, so the package's entry points switch it off on the session they get.
# Their projections would be compiled to single methods of tens of kilobytes, which the
# JVM only interprets; below its limit of 8,000 bytes Spark splits them into methods.
PLAN_CONF = {"spark.sql.constraintPropagation.enabled": "false", "spark.sql.codegen.hugeMethodLimit": "8000"}


def prepare_session(spark: SparkSession) -> SparkSession:
    for k, v in PLAN_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    On a cluster the setting names shared storage and is used as given; unset there it
    is an error, since executors could not see each other's files.  With a local master
    `_checkpoints` under the session's warehouse directory serves instead.  The
    session's settings are not changed.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    master = "local"
    try:
        conf = spark.sparkContext.getConf()
        path = path or conf.get("spark.checkpoint.dir", None)
        master = spark.sparkContext.master
    except Exception:  # noqa: BLE001 - no SparkContext handle (e.g. a remote session)
        master = "remote" if not path else master
    if not path:
        if not re.match(r"local(\[|$)", master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return path.rstrip("/")


ROW_GROUP_BYTES = 16 * 1024 * 1024
# Files one task of a partitioned write has open side by side (a row group each); a task with
# more partitions than that sorts the rows of the others.  Without it every task sorts all its rows.
OPEN_FILES = {"spark.sql.maxConcurrentOutputFileWriters": "16"}


# Folders written with a key, by (application, key): handed out again, never overwritten.
_written: dict[tuple[str, str], str] = {}
_writing = threading.Lock()


def _application(spark: SparkSession) -> str:
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - a remote session
        return str(id(spark))


def materialize(
    df: DataFrame, name: str, partition_by: list[str] | None = None, key: str | None = None, compression: str | None = None
) -> DataFrame:
    """Write `df` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the plan)
    and gives later filters a scan with pushed-down predicates.  Every write goes to a
    folder of its own, so a frame handed out earlier stays readable.  With `key` (what the
    rows depend on besides the files of the plan) the folder is written once for each
    application, key and state of the input files (names, sizes, times of change) and then
    read again; `release` forgets it.  A folder that cannot be written is an error.
    """
    spark = df.sparkSession
    if key is None:
        return spark.read.parquet(write_table(df, name, partition_by, compression))
    place = (_application(spark), f"{name}|{key}|{input_state(df)}")
    with _writing:  # one writer at a time; a second caller waits and reads
        if place not in _written:
            _written[place] = write_table(df, name, partition_by, compression)
        return spark.read.parquet(_written[place])


def input_state(df: DataFrame) -> str:
    """A digest of the input files of `df`: their names, and their number, sizes and times of
    change as Spark lists them (no content is read).  A file replaced under its old name
    changes it."""
    files = sorted(df.inputFiles())
    digest = hashlib.sha1("\n".join(files).encode()).hexdigest()
    if not files:
        return digest
    listed = df.sparkSession.read.format("binaryFile").load([unquote(f) for f in files])
    row = listed.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("path", "length", "modificationTime")).alias("state"),
    ).first()
    return f"{digest}|{row['n']}|{row['state']}"


def write_table(df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str | None = None) -> str:
    """Write `df` as Parquet to a new folder under the shared one; the folder's path."""
    path = f"{checkpoint_dir(df.sparkSession)}/panelcast/{name}-{uuid.uuid4().hex}"
    # Small row groups: each concurrent Parquet writer buffers one row group in memory.
    writer = df.write.option("parquet.block.size", ROW_GROUP_BYTES)
    if compression:
        writer = writer.option("compression", compression)
    if not partition_by:
        writer.parquet(path)
        return path
    with settings(df.sparkSession, OPEN_FILES):
        writer.partitionBy(*partition_by).parquet(path)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings `values` while the block runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def release(spark: SparkSession) -> None:
    """Delete what `materialize` has written with a key for this application.

    Frames read from it can no longer be used."""
    app = _application(spark)
    with _writing:
        for place in [p for p in _written if p[0] == app]:
            delete_folder(spark, _written.pop(place))


def delete_folder(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
