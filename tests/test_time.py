from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pandas.tseries.offsets import BDay
from pyspark.sql import functions as F

from deskgauge.functions import time as XT

ONE = "timestamp_ntz"


def at(text):
    return F.lit(text).cast(ONE)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize("start, days, expected", [
    ("2024-03-29 10:00:00", 1, "2024-04-01"), ("2024-03-29 10:00:00", 2, "2024-04-02"),
    ("2024-03-29 10:00:00", 3, "2024-04-03"), ("2024-03-29 10:00:00", 5, "2024-04-05"),
    ("2024-03-30 10:00:00", 1, "2024-04-01"), ("2024-03-30 10:00:00", 5, "2024-04-05"),
    ("2024-03-31 10:00:00", 2, "2024-04-02"), ("2024-03-31 10:00:00", 3, "2024-04-03"),
    ("2024-04-01 10:00:00", 1, "2024-04-02"), ("2024-04-01 10:00:00", 5, "2024-04-08"),
])
def test_add_business_days(spark, start, days, expected):
    assert str(one(spark, XT.add_business_days(at(start), days))) == expected + " 10:00:00"


@pytest.mark.parametrize("first, last, expected", [
    ("2024-01-01 10:00", "2024-01-09 10:00", 7),
    ("2024-01-01 15:00", "2024-01-09 10:00", 6),
    ("2024-01-01 15:00", "2024-01-06 10:00", 4),
    ("2024-01-01 10:00", "2024-01-06 15:00", 5),
    ("2024-01-06 15:00", "2024-01-09 10:00", 1),
    ("2024-01-06 15:00", "2024-01-14 10:00", 5),
    ("2024-01-06 15:00", "2024-01-14 16:00", 5),
    ("2024-01-09 10:00", "2024-01-01 10:00", 0),
])
def test_business_days_between(spark, first, last, expected):
    assert one(spark, XT.business_days_between(at(first), at(last))) == expected


def test_business_days_agree_with_pandas(spark, session_zone):
    base = pd.Timestamp("2024-02-26 09:30")
    starts = [base + pd.Timedelta(hours=7 * i) for i in range(60)]
    pairs = [(a, a + pd.Timedelta(hours=11 * j)) for a in starts for j in range(0, 30)]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string")
    a, b = F.col("a").cast(ONE), F.col("b").cast(ONE)
    rows = df.select(
        XT.business_days_between(a, b).alias("n"),
        *[XT.add_business_days(a, n).alias(f"p{n}") for n in (1, 2, 3, 5)],
    ).collect()
    for (first, last), row in zip(pairs, rows):
        assert row["n"] == len(pd.date_range(first, last, freq=BDay())), (first, last)
        for n in (1, 2, 3, 5):
            assert pd.Timestamp(row[f"p{n}"]) == first + BDay(n), (first, n)


@pytest.mark.parametrize("seconds, minutes, days", [
    (30, 0, 0), (90, 2, 0), (150, 2, 0), (86369, 1439, 0), (86370, 1440, 1),
    (-30, 0, 0), (-3600, -60, -1),
])
def test_round_to_minute_then_days(spark, seconds, minutes, days, session_zone):
    # Across the clock change of New York: durations are on the UTC line.
    start = dt.datetime(2024, 3, 10, 6, 59, 30)
    found = XT.minutes_between(at(str(start)), at(str(start + dt.timedelta(seconds=seconds))))
    assert one(spark, found) == minutes
    assert one(spark, XT.whole_days(found)) == days


@pytest.mark.parametrize("text, expected", [
    ("2021-01-01 00:00:00", None), ("2021-01-01 00:00:00.5", "2021-01-01 00:00:00.500000"),
    ("2021-01-01 00:00:00.123", "2021-01-01 00:00:00.123000"),
    ("2021-03-14 02:30:00.0", "2021-03-14 02:30:00"), ("2021-03-28 02:30:00.0", "2021-03-28 02:30:00"),
    ("2021-02-30 00:00:00.0", None), ("soon", None), (None, None),
])
def test_parse_utc(spark, session_zone, text, expected):
    found = one(spark, XT.parse_utc(F.lit(text).cast("string")))
    assert (None if found is None else str(found)) == expected


def test_parse_utc_other_format(spark):
    assert one(spark, XT.parse_utc(F.lit("31/12/2021 23:59"), "dd/MM/yyyy HH:mm")) == dt.datetime(
        2021, 12, 31, 23, 59)


@pytest.mark.parametrize("text, expected", [
    ("26/02/2021", "2021-02-26 00:00:00"), ("1/2/2021", "2021-02-01 00:00:00"),
    ("31/02/2021", None), ("26-02-2021", None), (" 26/02/2021", None), ("", None),
])
def test_parse_day(spark, session_zone, text, expected):
    found = one(spark, XT.parse_day(F.lit(text)))
    assert (None if found is None else str(found)) == expected


def test_as_utc_of_instants(spark, session_zone):
    df = spark.createDataFrame(
        [(dt.datetime(2021, 7, 1, tzinfo=dt.timezone.utc),)], "t timestamp")
    found = df.select(XT.as_utc(F.col("t"), df.schema["t"].dataType).alias("u")).collect()
    assert found[0]["u"] == dt.datetime(2021, 7, 1)


def test_local_clock_and_formats(spark, session_zone):
    wall = XT.local(at("2021-07-01 00:00:00"))
    assert one(spark, wall) == dt.datetime(2021, 7, 1, 2)
    assert one(spark, XT.local_date(at("2021-06-30 23:00:00"))) == dt.date(2021, 7, 1)
    # 02:30 does not exist in New York on that day; the text must not move.
    assert one(spark, XT.short_text(at("2021-03-14 02:30:59"))) == "14/03/21 02:30"
    assert one(spark, XT.day_text(at("2021-03-14 02:30:00.5"))) == "2021-03-14"


def test_calendar_millis(spark):
    assert one(spark, XT.calendar_millis_text(at("2021-03-01 00:00:00"))) == "1614560400000"
    assert one(spark, XT.calendar_millis_text(F.lit(None).cast(ONE))) == ""


def test_moment_takes_aware_times():
    zone = dt.timezone(dt.timedelta(hours=2))
    assert "2024-01-01 10:00" in str(XT.moment(dt.datetime(2024, 1, 1, 12, tzinfo=zone)))


def test_fractional_days(spark):
    assert one(spark, XT.fractional_days(F.lit(2160))) == 1.5
