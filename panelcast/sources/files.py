"""File sources and sinks.

* read_bars: one CSV per ticker (Date, Open, High, Low, Close, Volume) under a folder;
  the ticker is the file name without ".csv" (dots such as BRK.B kept).  All files are
  one scan with an explicit schema - no per-file Python loop.
* The reference drops a whole file that it cannot read.  Here a row that does not parse
  or has no date marks its ticker as rejected: those tickers are removed from the bars
  (anti-join against a per-ticker flag, an aggregate of one row per ticker) and
  returned in a `rejects` DataFrame with the reason.  An empty price or volume is a
  missing value and stays one; prices of zero or less stay as they are (see log_return).
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.splits import between_dates
from ..schema import BAR_FILE_SCHEMA, INDEX_BARS_SCHEMA, REFERENCE_INDICES


def ticker_from_path(col: str = "_metadata.file_name"):
    """File name without its .csv suffix.  Spark gives names as they stand in an address, with
    some characters (^, space) as %XX; a plus sign stands for itself there."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(col), F.lit("+"), F.lit("%2B"))), r"\.csv$", "")


def matches(spark: SparkSession, pattern: str) -> int:
    """How many files and folders a path with a pattern stands for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return len(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [])


def read_bars(
    spark: SparkSession, folder: str, pattern: str = "*.csv", broadcast_limit: int = 2_000_000
) -> tuple[DataFrame, DataFrame]:
    """S1 + S2 + S3: (bars, rejects).

    bars: Ticker, Date, Open, High, Low, Close, Volume of tickers whose every row parses;
    rejects: Ticker, bad_rows, reason.
    """
    # Cells are read as text and parsed here, so that every cell is checked whichever
    # columns a query needs.
    names = [f.name for f in BAR_FILE_SCHEMA.fields]
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader, place = spark.read.schema(text).option("header", True), folder.rstrip("/")
    # One listing of the folder: by a path with a pattern every file is a path of its own, each
    # looked up and listed by itself.  Folders within the folder are left to the pattern.
    flat = "/" not in pattern and matches(spark, f"{place}/{pattern}") > 0 and matches(spark, f"{place}/*/*") == 0
    found = reader.option("pathGlobFilter", pattern).csv(place) if flat else reader.csv(f"{place}/{pattern}")
    cells = found.withColumn("Ticker", ticker_from_path())
    parsed = {f.name: F.trim(f.name).try_cast(f.dataType) for f in BAR_FILE_SCHEMA.fields}
    unread = [(F.trim(n) != "") & v.isNull() for n, v in parsed.items()]
    bad = parsed["Date"].isNull()
    for wrong in unread:
        bad = bad | F.coalesce(wrong, F.lit(False))
    number = lambda v: F.when(~F.isnan(v), v)  # noqa: E731  the text NaN is a missing value
    raw = cells.withColumn("_bad", bad).withColumns({n: v if n == "Date" else number(v) for n, v in parsed.items()})
    flagged = raw
    rejects = (
        flagged.groupBy("Ticker")
        .agg(F.sum(F.col("_bad").cast("long")).alias("bad_rows"))
        .filter(F.col("bad_rows") > 0)
        .withColumn("reason", F.lit("unparsable row"))
    )
    # One row per rejected ticker: counted, then broadcast so the bars are not
    # shuffled by ticker (a hot ticker would otherwise land in one task).
    rejected = rejects.select("Ticker")
    n_rejected = rejected.count()
    if n_rejected == 0:
        kept = flagged
    else:
        side = F.broadcast(rejected) if n_rejected <= broadcast_limit else rejected
        kept = flagged.join(side, "Ticker", "left_anti")
    bars = kept.select(
        "Ticker", "Date", "Open", "High", "Low", "Close", "Volume"
    )
    return bars, rejects


def write_bars(bars: DataFrame, folder: str) -> None:
    """The inverse of `read_bars`: one CSV file for each ticker, named after it.

    Spark writes a folder for each ticker; each one's only file is then given its name
    through the Hadoop file system, one rename a ticker.  The target must be a new folder."""
    spark, names = bars.sparkSession, [f.name for f in BAR_FILE_SCHEMA.fields]
    target = folder.rstrip("/")
    parts = f"{target}/_parts"
    rows = bars.select(*names, F.col("Ticker").alias("_ticker")).repartition("_ticker").sortWithinPartitions("_ticker", "Date")
    rows.write.option("header", True).partitionBy("_ticker").csv(parts)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    for found in fs.globStatus(path(f"{parts}/_ticker=*/part-*")):
        ticker = unquote(found.getPath().getParent().getName().split("=", 1)[1])
        if not fs.rename(found.getPath(), path(f"{target}/{ticker}.csv")):
            raise OSError(f"cannot name the file of {ticker}")
    fs.delete(path(parts), True)


def local_dates(
    df: DataFrame, zones: DataFrame, series: str = "IndexName", stamp: str = "Date", broadcast_limit: int = 1_000_000
) -> DataFrame:
    """X0 + F6 by series: `stamp` becomes the wall-clock date in the zone of the row's series.

    `zones` has one row a series: its name (in the column `series`) and its Zone, such as
    America/New_York.  It is counted first: a series named twice is an error, and the table
    is broadcast below the limit.  A series that it does not name keeps dates in UTC, a null
    stamp stays null.  Timestamps without a zone are in UTC; dates by the session's zone play
    no part.  A stamp that is a date already is taken for midnight in UTC.
    """
    n, names = zones.agg(F.count(F.lit(1)), F.count_distinct(F.struct(series))).first()
    if n != names:
        raise ValueError(f"{n - names} rows of the zone table name a series again")
    side = zones.select(series, F.col("Zone").alias("_zone"))
    joined = df.join(F.broadcast(side) if n <= broadcast_limit else side, series, "left")
    at = F.col(stamp)
    if isinstance(df.schema[stamp].dataType, T.TimestampType):  # an instant: count from the epoch in UTC
        seconds = (F.unix_micros(at).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
        at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)
    wall = F.convert_timezone(F.lit("UTC"), F.coalesce("_zone", F.lit("UTC")), at.cast("timestamp_ntz"))
    return joined.withColumn(stamp, F.to_date(wall)).select(*df.columns)


def read_index_bars(
    spark: SparkSession,
    path: str,
    names: list[str] | None = None,
    start: str = "2018-01-01",
    end: str | None = None,
    fmt: str = "parquet",
    zone: str | None = None,
    zones: DataFrame | None = None,
) -> DataFrame:
    """S5 re-aimed (X0, F6, F8): index bars from a long table instead of a web API.

    Dates given as timestamps are reduced to the wall-clock date in `zone`, or in the zone
    of their series by the table `zones` (see `local_dates`); `end` defaults to today.
    Filters are pushed to the scan.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.schema(INDEX_BARS_SCHEMA).option("header", True)
    df = reader.load(path)
    date = F.col("Date")
    if zones is not None:
        df = local_dates(df, zones)
    elif zone is not None:
        date = F.to_date(F.from_utc_timestamp(F.col("Date").cast("timestamp"), zone))
    df = df.withColumn("Date", F.to_date(date))
    df = df.filter(F.col("Date") >= F.lit(start).cast("date"))
    df = df.filter(F.col("Date") < (F.lit(end).cast("date") if end else F.current_date()))
    if names:
        df = df.filter(F.col("IndexName").isin(names))
    return df.select("IndexName", "Date", "Open", "High", "Low", "Close", "Volume")


def name_index_symbols(df: DataFrame, symbol_col: str = "Symbol") -> DataFrame:
    """S5 naming: map quote symbols (e.g. ^N225) to the reference's index names
    (Nikkei_225, ...); rows with other symbols keep the symbol as their name."""
    pairs = [F.lit(x) for name, sym in REFERENCE_INDICES.items() for x in (sym, name)]
    mapping = F.create_map(*pairs)
    return df.withColumn("IndexName", F.coalesce(mapping[F.col(symbol_col)], F.col(symbol_col)))


def read_panel(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A stored panel (Parquet by default, CSV with a header at the edge)."""
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path).withColumn(
            "Date", F.to_date("Date")
        )
    return spark.read.parquet(path)


def write_panel(panel: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite-write the panel partitioned by year, rows sorted within files."""
    out = panel.withColumn("year", F.year("Date")).sortWithinPartitions("Ticker", "Date")
    writer = out.write.mode("overwrite").partitionBy("year")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def write_folds(panel: DataFrame, summary: DataFrame, path: str, test_start=None) -> None:
    """S7 on request: fold_k_train / fold_k_validation / final_test / splits_summary.

    The fold table has at most n_splits rows; each export is a filtered write.
    """
    base = path.rstrip("/")
    for r in summary.collect():
        k = r["fold"]
        between_dates(panel, hi=r["train_end"]).write.mode("overwrite").parquet(f"{base}/fold_{k}_train")
        between_dates(panel, r["val_start"], r["val_end"]).write.mode("overwrite").parquet(f"{base}/fold_{k}_validation")
    if test_start is not None:
        between_dates(panel, lo=test_start).write.mode("overwrite").parquet(f"{base}/final_test")
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{base}/splits_summary")


def write_reports(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """S13 re-aimed: evaluation tables (metrics, confusion, curves, thresholds) as files."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        target = f"{path.rstrip('/')}/{name}"
        if fmt == "csv":
            w.option("header", True).csv(target)
        else:
            w.parquet(target)
