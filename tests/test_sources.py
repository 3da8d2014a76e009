import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelcast.operators.technical import technical_panel
from panelcast.sources.files import read_bars, write_panel, read_panel


def test_csv_bars_with_ticker_names_and_rejects(spark, tmp_path):
    good = "Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,100\n2020-01-03,1.5,2,1,1.8,120\n"
    bad = "Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,100\n2020-01-03,x,2,1,oops,120\n"
    (tmp_path / "BRK.B.csv").write_text(good)
    (tmp_path / "AAA.csv").write_text(good)
    (tmp_path / "BAD.csv").write_text(bad)
    bars, rejects = read_bars(spark, str(tmp_path))
    assert sorted({r.Ticker for r in bars.collect()}) == ["AAA", "BRK.B"]
    assert [r.Ticker for r in rejects.collect()] == ["BAD"]
    assert bars.filter("Ticker = 'AAA'").orderBy("Date").first().Date == dt.date(2020, 1, 2)


def test_only_unparsable_rows_reject_a_ticker(spark, tmp_path):
    """An empty, zero or negative price loses the windows it is in, not the ticker."""
    days = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), 100 + (i * 37 % 11)) for i in range(130)]
    head = "Date,Open,High,Low,Close,Volume\n"
    line = lambda d, c: f"{d},{c},{c + 1},{c - 1},{c},{10 + c}\n"
    for name, odd in (("EMPTY", ""), ("ZERO", "0"), ("NEG", "-5"), ("BAD", "oops")):
        rows = [line(d, c) if i != 60 else f"{d},{c},{c + 1},{c - 1},{odd},{10 + c}\n" for i, (d, c) in enumerate(days)]
        (tmp_path / f"{name}.csv").write_text(head + "".join(rows))
    bars, rejects = read_bars(spark, str(tmp_path))
    assert [r.Ticker for r in rejects.collect()] == ["BAD"]
    assert {r.Ticker: r["count"] for r in bars.groupBy("Ticker").count().collect()} == {"EMPTY": 130, "ZERO": 130, "NEG": 130}
    kept = {r.Ticker: r["count"] for r in technical_panel(bars).groupBy("Ticker").count().collect()}
    # 50 bars before the first full window less one, and 50 windows of MA_50 that hold the gap.
    assert kept["EMPTY"] == 130 - 1 - 49 - 50
    # ln is missing on both sides of a negative price: its longest windows hold 20 returns.
    assert kept["NEG"] == 130 - 1 - 49 - 21 and kept["ZERO"] > 0


def test_panel_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("A", dt.date(2020, 1, 2), 1.0)], "Ticker string, Date date, x double")
    write_panel(df, str(tmp_path / "p"))
    back = read_panel(spark, str(tmp_path / "p"))
    assert back.count() == 1 and "year" in back.columns


def test_index_symbols_are_named(spark):
    from panelcast.sources.files import name_index_symbols

    df = spark.createDataFrame([("^N225",), ("^DJI",), ("OTHER",)], "Symbol string")
    assert [r.IndexName for r in name_index_symbols(df).collect()] == ["Nikkei_225", "DJIA", "OTHER"]


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York", "Asia/Tokyo"])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_dates_by_the_zone_of_each_series(spark, session_zone, kind):
    """Hours around both changes of the clock, against the standard library's zones."""
    from zoneinfo import ZoneInfo

    from panelcast.sources.files import local_dates

    zones = {"NY": "America/New_York", "London": "Europe/London", "Tokyo": "Asia/Tokyo", "Sydney": "Australia/Sydney"}
    starts = [dt.datetime(2021, 3, 13), dt.datetime(2021, 11, 6), dt.datetime(2021, 3, 27), dt.datetime(1960, 10, 30)]
    stamps = [s + dt.timedelta(minutes=30 * i) for s in starts for i in range(144)]
    rows = [(n, i, s.isoformat(sep=" ")) for n in [*zones, "none"] for i, s in enumerate(stamps)] + [("NY", -1, None)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        text = F.col("s") if kind == "timestamp_ntz" else F.concat("s", F.lit("Z"))
        df = spark.createDataFrame(rows, "IndexName string, i int, s string").select("IndexName", "i", text.cast(kind).alias("Date"))
        table = spark.createDataFrame(list(zones.items()), "IndexName string, Zone string")
        got = {(r.IndexName, r.i): r.Date for r in local_dates(df, table).collect()}
        for limit in (0,):  # the join without a broadcast gives the same rows
            assert {(r.IndexName, r.i): r.Date for r in local_dates(df, table, broadcast_limit=limit).collect()} == got
        with pytest.raises(ValueError):
            local_dates(df, table.union(table))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    utc = dt.timezone.utc
    for name in [*zones, "none"]:
        for i, s in enumerate(stamps):
            want = s.replace(tzinfo=utc).astimezone(ZoneInfo(zones.get(name, "UTC"))).date()
            assert got[name, i] == want, (name, s)
    assert got["NY", -1] is None
