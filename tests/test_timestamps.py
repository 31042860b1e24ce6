"""Timestamp normalisation against the standard library, and its defined edge results."""

import datetime as dt
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from lumenfold.functions.timestamps import days_from_civil, normalise_timestamps
from lumenfold.operators.instants import all_instants, asset_instants

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def micros(value: dt.datetime) -> int:
    return (value - EPOCH) // dt.timedelta(microseconds=1)


def parse(spark, values, zone="Europe/Berlin", order=None):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string")
    out = normalise_timestamps(df, "v", "us", fallback_zone=F.lit(zone), date_order=F.lit(order))
    return [r.us for r in out.orderBy("id").collect()]


def test_layouts(spark):
    utc = lambda *a: micros(dt.datetime(*a, tzinfo=dt.timezone.utc))
    cases = {
        "2013:01:02 13:27:32": utc(2013, 1, 2, 12, 27, 32), "2013-11-25 13:45:03 MST": utc(2013, 11, 25, 20, 45, 3),
        "Apr 2, 2022, 3:28:05 PM UTC": utc(2022, 4, 2, 15, 28, 5), " 10 July 2014, 07:23 ": utc(2014, 7, 10, 5, 23),
        "Fri, 03 Apr 2015 16:55:07 +0545": utc(2015, 4, 3, 11, 10, 7), "1358309641": 1358309641 * 10**6, "1358371196934": 1358371196934000,
        "1382929672753436404": 1382929672753436, "1367242608.425067": 1367242608425067, "2018-06": utc(2018, 6, 15, 10), "2018": utc(2018, 7, 1, 10),
        "20190618": utc(2019, 6, 18, 10), "20130225_002019": utc(2013, 2, 24, 23, 20, 19), "20130326T195639Z": utc(2013, 3, 26, 19, 56, 39),
        "2013-01-28-06-02-46": utc(2013, 1, 28, 5, 2, 46), "03.04.2024 10:16:15": utc(2024, 4, 3, 8, 16, 15), "\t2013-04-16T11:29:37\n": utc(2013, 4, 16, 9, 29, 37),
        "2021-10-31 02:30:00": utc(2021, 10, 31, 0, 30), "2021-03-28 02:30:00": utc(2021, 3, 28, 1, 30), "12:30": None,
        "2021-02-30T10:15:00": None, "0000:00:00 00:00:00": None, "2020-11-31 25:61:00": None, "2019:13:05 08:00:00": None, "not-a-date": None,
        "": None, "   ": None, None: None, "2019-12-05T08:00:00 QQQ": None, "2019-12-05T08:00:00+25:00": None, "x" * 100_000: None,
    }
    assert parse(spark, list(cases)) == list(cases.values())


def test_slashes_follow_the_date_order(spark):
    assert parse(spark, ["01/03/2013 5:17:24 PM"], "UTC", "mdy") == [micros(dt.datetime(2013, 1, 3, 17, 17, 24, tzinfo=dt.timezone.utc))]
    assert parse(spark, ["01/03/2013 17:17:24"], "UTC", "dmy") == [micros(dt.datetime(2013, 3, 1, 17, 17, 24, tzinfo=dt.timezone.utc))]
    assert parse(spark, ["13/30/2013 1:00:00 AM"], "UTC", "mdy") == [None]


@pytest.mark.parametrize("zone", ["Australia/Lord_Howe", "America/St_Johns", "Asia/Kathmandu", "America/New_York", "UTC"])
def test_wall_clocks_equal_the_standard_library(spark, zone):
    rng, tz = random.Random(zone), ZoneInfo(zone)
    walls = [dt.datetime(2010, 1, 1) + dt.timedelta(seconds=rng.randrange(16 * 365 * 86400)) for _ in range(300)]
    # the hours round the changes of each year
    for year in (2015, 2021):
        walls += [dt.datetime(year, m, d, h, 15) for m in (3, 4, 10, 11) for d in range(1, 29) for h in (0, 1, 2, 3)]
    want = []
    for w in walls:
        early = w.replace(tzinfo=tz, fold=0)  # in a gap fold 0 takes the earlier offset, which moves forward
        want.append(micros(early.astimezone(dt.timezone.utc)))
    assert parse(spark, [w.isoformat() for w in walls], zone) == want


def test_unknown_zone_has_no_instant_but_offsets_do(spark):
    assert parse(spark, ["2020-01-01T00:00:00", "2020-01-01T00:00:00Z"], "Nowhere/At_All") == [None, 1577836800000000]


def test_integer_days(spark):
    days = [dt.date(1, 1, 1), dt.date(1969, 12, 31), dt.date(2000, 2, 29), dt.date(2100, 3, 1), dt.date(9999, 12, 31)]
    df = spark.createDataFrame([(i, d.year, d.month, d.day) for i, d in enumerate(days)], "i int, y long, m long, d long")
    got = [r.x for r in df.selectExpr("i", f"{days_from_civil('y', 'm', 'd')} AS x").orderBy("i").collect()]
    assert got == [(d - dt.date(1970, 1, 1)).days for d in days]


def test_extra_and_clashing_columns_pass_through(spark):
    df = spark.createDataFrame([("2020", 1, "a")], "v string, us int, `odd.name` string")
    assert normalise_timestamps(df, "v", "us", fallback_zone=F.lit("UTC")).columns == ["v", "odd.name", "us"]


def test_tables(spark):
    t = dt.datetime
    sources = spark.createDataFrame([("s", "Europe/Berlin", "dmy")], "source_name string, time_zone string, date_order string")
    assets = spark.createDataFrame(
        [(1, "s", "2020-01-01T12:00:00", t(2024, 1, 1)), (1, "s", "2020-01-02T12:00:00", t(2024, 1, 2)), (1, "s", "2020-01-02T12:00:00", t(2024, 1, 2)),
         (2, None, "2020-01-01T12:00:00", t(2024, 1, 1)), (None, "s", "2020", t(2024, 1, 1)), (3, "s", None, None)],
        "asset_id long, source_name string, captured_at string, last_seen_at timestamp_ntz")
    evidence = spark.createDataFrame([(7, 1, "2020-06-01 10:00", None), (7, 1, "2020-06-01 10:00", None), (8, 1, "2020-06-01 10:00", "-05:00"), (9, 99, "2020-06-01 10:00", None)],
                                     "evidence_id long, asset_id long, candidate_timestamp string, timezone string")
    got = {(r.record_kind, r.record_id): r.utc_micros for r in all_instants(assets, evidence, sources).collect()}
    at = lambda *a: micros(t(*a, tzinfo=dt.timezone.utc))
    assert got == {("asset", 1): at(2020, 1, 2, 11), ("evidence", 7): at(2020, 6, 1, 8), ("evidence", 8): at(2020, 6, 1, 15)}
    assert asset_instants(assets.limit(0), sources).count() == 0
