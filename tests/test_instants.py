import datetime as dt
import zoneinfo

from pyspark.sql import functions as F

from siftlake.functions.instants import instant_millis


def ms(spark, values, zone="Europe/Berlin", order="dmy"):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(instant_millis(F.col("t"), F.lit(zone).cast("string"), F.lit(order).cast("string"))).collect()]


def utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1000)


def test_numbers_by_size(spark):
    assert ms(spark, ["1714528567", "1714528567019", "1714528567019123", "1714528567019999999", "1714528567.0199", " 1714528567\n", "0", "0.0", "00", "NaN", "-"]) == [
        1714528567000, 1714528567019, 1714528567019, 1714528567019, 1714528567019, 1714528567000, None, None, None, None, None,
    ]


def test_written_zones(spark):
    want = utc(2024, 7, 18, 16, 19, 13)
    same = ["2024-07-18 18:19:13 CEST", "2024-07-18T18:19:13+02:00", "2024-07-18t21:49:13+0530", "2024-07-18 18:19:13 [Europe/Berlin]", "2024-07-18T12:19:13[America/New_York]", "20240718T161913Z", "Thu, 18 Jul 2024 16:19:13 +0000", "2024-07-18 16:19:13-00:00", "2024-07-18 11:19:13 EST"]
    assert ms(spark, same, None, None) == [want] * len(same)


def test_machine_zone_and_order(spark):
    assert ms(spark, ["04/03/2024 1:00:00 PM"]) == [utc(2024, 3, 4, 12)]
    assert ms(spark, ["04/03/2024 12:00:00 AM"], "America/New_York", "mdy") == [utc(2024, 4, 3, 4)]
    assert ms(spark, ["04.03.2024 13:00:00"], "Europe/Berlin", "mdy") == [utc(2024, 3, 4, 12)]
    assert ms(spark, ["2024-03-04 13:00:00", "04/03/2024 13:00:00"], None, None) == [None, None]
    assert ms(spark, ["2024-03-04 13:00:00"], "No/Where") == [None]


def test_daylight_saving(spark):
    # twice: the earlier; skipped: forward by the gap
    assert ms(spark, ["2024-10-27 02:30:00", "2024-03-31 02:30:00"]) == [utc(2024, 10, 27, 0, 30), utc(2024, 3, 31, 1, 30)]


def test_impossible_is_none(spark):
    bad = ["2023-02-29T08:00:00Z", "2024-13-01 00:00:00Z", "2024-00-10 00:00:00Z", "0000-00-00 00:00:00", "2024-01-01 25:00:00Z", "2024-01-01 10:60:00Z", "31/04/2024 10:00:00", "12:30:00", "yesterday", "n/a", "null", "", "   ", None, "13/01/2024 13:00:00 PM", "2024-01-01 10:00:00 XYZ", "2024-01-01 10:00:00 Foo/Bar", "x" * 5000]
    assert ms(spark, bad) == [None] * len(bad)


def test_every_hour_of_a_year_against_zoneinfo(spark):
    for zone in ("Europe/London", "Australia/Sydney", "Asia/Kathmandu", "America/Los_Angeles"):
        start = dt.datetime(2024, 1, 1)
        walls = [start + dt.timedelta(hours=h, minutes=17) for h in range(0, 366 * 24, 5)]
        got = ms(spark, [w.strftime("%Y-%m-%d %H:%M:%S.987") for w in walls], zone)
        for w, g in zip(walls, got, strict=True):
            t = w.replace(tzinfo=zoneinfo.ZoneInfo(zone), fold=0).astimezone(dt.UTC)
            assert g == int(t.timestamp()) * 1000 + 987


def test_unbracketed_zone_names_after_the_time(spark):
    zones = ["America/New_York", "Asia/Kathmandu", "Australia/Sydney", "Africa/Cairo", "Atlantic/Reykjavik", "Pacific/Auckland", "Europe/Berlin", "Antarctica/Troll", "Arctic/Longyearbyen", "Indian/Maldives", "America/Argentina/Buenos_Aires"]
    day = dt.datetime(2025, 5, 13, 3, 49)
    rows = [(f"2025-05-13 {clock}{gap}{zone}", int(day.replace(hour=hour, tzinfo=zoneinfo.ZoneInfo(zone)).timestamp() * 1000)) for zone in zones for clock, hour in (("03:49", 3), ("03:49 PM", 15), ("03:49am", 3)) for gap in (" ", "  ")]
    got = spark.createDataFrame(rows, "t string, want long").select("t", "want", instant_millis(F.col("t"))).collect()
    assert [tuple(r) for r in got if r[1] != r[2]] == []
