"""Stand-in inputs derived from the driver's TPC-H-like tables (FIXTURES A and B).

These only shape rows into the bar schemas; every feature, split and metric is
computed later by the library's operators on whatever rows arrive here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bars_from_lineitem(spark: SparkSession, sf_dir: str, freq: str = "day") -> DataFrame:
    """One OHLCV bar per (supplier, ship date): Ticker = 'S' || l_suppkey.

    price = l_extendedprice / l_quantity; Open / Close are the prices of the smallest /
    largest (l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) of the
    day; High / Low the max / min price; Volume the summed quantity.  `freq='week'`
    buckets ship dates to Mondays for bars with an intraday range.  A supplier ships
    about one line a day, so aggregating before the shuffle would not make fewer rows, only
    wider ones (four copies of the tie), sorted once more: the narrow lines are dealt by
    supplier and day, then aggregated.
    """
    li = table(spark, sf_dir, "lineitem")
    day = F.to_date(F.col("l_shipdate"))
    date = day if freq == "day" else F.to_date(F.date_trunc(freq, F.col("l_shipdate")))
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    return (
        li.select("l_suppkey", date.alias("Date"), *order)
        .repartition("l_suppkey", "Date")
        .select("l_suppkey", "Date", price.alias("_price"), F.struct(*order).alias("_tie"), F.col("l_quantity").cast("double").alias("_qty"))
        .groupBy("l_suppkey", "Date")
        .agg(
            F.min_by("_price", "_tie").alias("Open"),
            F.max("_price").alias("High"),
            F.min("_price").alias("Low"),
            F.max_by("_price", "_tie").alias("Close"),
            F.sum("_qty").alias("Volume"),
        )
        .withColumn("Ticker", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
        .select("Ticker", "Date", "Open", "High", "Low", "Close", "Volume")
    )


def index_bars_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One index series per region: Close = mean order total of the day.

    orders -> customer -> nation -> region; nation and region are a few rows and are
    broadcast by the planner from their file statistics, customer joins by key.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy(F.col("r_name").alias("IndexName"), F.to_date("o_orderdate").alias("Date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("Open"),
        F.max("o_totalprice").alias("High"),
        F.min("o_totalprice").alias("Low"),
        F.avg("o_totalprice").alias("Close"),
        F.count(F.lit(1)).cast("double").alias("Volume"),
    )


# A zone for each region, with and without summer time.
REGION_ZONES = {
    "AFRICA": "Africa/Johannesburg",
    "AMERICA": "America/New_York",
    "ASIA": "Asia/Tokyo",
    "EUROPE": "Europe/London",
}


def order_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick an order (IndexName = region, Date = a UTC timestamp, Price): the order's day
    at a second that follows from its key."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    second = F.pmod(F.col("o_orderkey") * 7919, F.lit(86_400)).cast("decimal(18,6)")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("IndexName"),
            (F.to_date("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=second)).alias("Date"),
            F.col("o_orderkey").alias("Tick"),
            F.col("o_totalprice").cast("double").alias("Price"),
        )
    )
