from __future__ import annotations

from datetime import datetime
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fieldtally.functions import numbers, text, times
from fieldtally.functions.projection import with_utm


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("form", "given", "expected"),
    [
        ("ymd", "2018-01-05", datetime(2018, 1, 5)),
        ("ymd", "2018-1-5", datetime(2018, 1, 5)),
        ("ymd", "2020-13-01", None),
        ("ymd", "2020", None),
        ("ymd", "2020-01", None),
        ("ymd", "2020-01-01Z", None),
        ("ymd", "1/5/2018", None),
        ("mdy", "1/5/2018", datetime(2018, 1, 5)),
        ("mdy", "01/05/2018", datetime(2018, 1, 5)),
        ("mdy", "13/05/2018", None),
        ("mdy", "2018-01-05", None),
        ("ymd", None, None),
    ],
)
def test_parse_date(spark, form, given, expected):
    assert value(spark, times.parse_date(F.lit(given).cast("string"), form)) == expected


@pytest.mark.parametrize(
    ("date", "time", "form", "kind", "expected"),
    [
        ("2018-01-05", "10:00:05", "ymd", "seconds", datetime(2018, 1, 5, 10, 0, 5)),
        ("2018-01-05", "10:00", "ymd", "seconds", None),
        ("2018-01-05", None, "ymd", "seconds", None),
        ("1/5/2018", "9:05", "mdy", "minutes", datetime(2018, 1, 5, 9, 5)),
        ("2018-01-05", "25:00:00", "ymd", "seconds", None),
        # Times skipped when the clocks are put forward never were.
        ("2020-03-08", "01:59:59", "ymd", "seconds", datetime(2020, 3, 8, 1, 59, 59)),
        ("2020-03-08", "02:00:00", "ymd", "seconds", None),
        ("2020-03-08", "02:59:59", "ymd", "seconds", None),
        ("2020-03-08", "03:00:00", "ymd", "seconds", datetime(2020, 3, 8, 3)),
        ("4/7/1996", "2:30", "mdy", "minutes", None),
        # A time shown twice is one wall-clock time.
        ("2020-11-01", "01:30:00", "ymd", "seconds", datetime(2020, 11, 1, 1, 30)),
    ],
)
def test_parse_datetime(spark, date, time, form, kind, expected):
    try:
        for session_zone in ("America/Los_Angeles", "UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", session_zone)
            column = times.parse_datetime(F.lit(date), F.lit(time).cast("string"), form, kind)
            assert value(spark, column) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_other_zones_skip_other_times(spark):
    args = F.lit("2020-03-08"), F.lit("02:30:00")
    assert value(spark, times.parse_datetime(*args, zone="Europe/Berlin")) == datetime(2020, 3, 8, 2, 30)
    assert value(spark, times.parse_datetime(F.lit("2020-03-29"), F.lit("02:30:00"), zone="Europe/Berlin")) is None


def test_to_minute_drops_seconds(spark):
    moment = F.lit("2018-01-05 10:00:40").cast("timestamp_ntz")
    assert value(spark, times.to_minute(moment)) == datetime(2018, 1, 5, 10, 0)


def test_paste_shows_missing_values(spark):
    assert value(spark, text.paste_na(F.lit("A"), F.lit(None))) == "A NA"
    assert value(spark, text.paste_na(F.lit("D6"), F.lit(None), sep="-")) == "D6-NA"


@pytest.mark.parametrize(
    ("number", "expected"),
    [(12.0, "12"), (1.25, "1.25"), (0.0, "0"), (100.0, "100"), (12345678.0, "12345678"), (None, "NA")],
)
def test_number_text(spark, number, expected):
    assert value(spark, text.number_text(F.lit(number).cast("double"))) == expected


def test_replace_first_only(spark):
    assert value(spark, text.replace_first(F.lit("a_b_c"), "_", " ")) == "a b_c"
    assert value(spark, text.readable(F.lit("Fish"))) == "Fish"


@pytest.mark.parametrize(
    ("station", "expected"),
    [("NZ EZ2 SJR", "EZ2 SJR"), ("EZ6 SJR b", "EZ6 SJR"), ("EZ2 x", "EZ2"), ("D4", "D4")],
)
def test_longer_names_first(spark, station, expected):
    names = ["EZ6 SJR", "EZ2 SJR", "EZ2", "EZ6"]
    assert value(spark, text.first_containing(F.lit(station), names)) == expected


def test_recode_keeps_other_values(spark):
    changes = {"USGS": "SFBS", "twentymm": "20mm"}
    assert value(spark, text.recode(F.lit("USGS"), changes)) == "SFBS"
    assert value(spark, text.recode(F.lit("EMP"), changes)) == "EMP"
    assert value(spark, text.recode(F.lit(None).cast("string"), changes)) is None


def test_split_part_and_link(spark):
    assert value(spark, text.split_part(F.lit("D28A-L"), "-", 1)) == "D28A"
    assert value(spark, text.split_part(F.lit("D6"), "-", 2)) is None
    assert value(spark, text.link(F.lit("u"), F.lit("l"))) == "<a href='u'>l</a>"


def test_strict_aggregates(frame):
    table = frame("k string, v double", ("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", None))
    means = table.groupBy("k").agg(
        numbers.strict_avg(F.col("v")).alias("avg"),
        numbers.strict_sum(F.col("v")).alias("sum"),
    )
    assert {r.k: (r.avg, r.sum) for r in means.collect()} == {"a": (2.0, 4.0), "b": (None, None)}


def test_half_even(spark):
    assert value(spark, numbers.half_even(F.lit(0.125), 2)) == 0.12
    assert value(spark, numbers.half_even(F.lit(5) / F.lit(4), 2)) == 1.25
    assert value(spark, numbers.half_even(F.lit(1) / F.lit(40), 2)) == 0.03
    assert value(spark, numbers.half_even(F.lit(23) / F.lit(40), 2)) == 0.57
    assert value(spark, numbers.half_even(F.lit(None).cast("double"), 2)) is None


def test_half_even_equals_exact_fractions(spark):
    pairs = [(x, n) for n in range(1, 73) for x in range(-20, 400)] + [(10**15 + 1, 2), (2**60, 1)]
    table = spark.createDataFrame(pairs, "x long, n long").select(
        (F.col("x") / F.col("n")).alias("value"),
        numbers.half_even(F.col("x") / F.col("n"), 2).alias("rounded"),
        numbers.half_even(F.col("x") / F.col("n"), 0).alias("whole"),
    )
    for row in table.collect():
        assert row.rounded == float(Fraction(round(Fraction(row.value) * 100), 100))
        assert row.whole == float(round(Fraction(row.value)))


def test_log_scale_inverts(spark):
    assert value(spark, numbers.unlog_scale(numbers.log_scale(F.lit(41)))) == 41.0


def test_any_positive_is_never_null(frame):
    table = frame("a int, b int", (0, 1), (None, None), (None, 2), (0, 0))
    assert [r.v for r in table.select(numbers.any_positive(["a", "b"]).alias("v")).collect()] == [
        True, False, True, False,
    ]


def test_utm_known_points(frame):
    table = frame("Latitude double, Longitude double", (0.0, -120.0), (38.0, -123.0))
    first, second = with_utm(table).collect()
    assert (round(first.x, 3), first.y) == (833978.557, 0.0)
    assert second.x == 500000.0
    assert round(second.y) == 4205815


def test_utm_off_the_meridian(frame):
    """The grid position published for a tower in zone 17."""
    tower = frame("Latitude double, Longitude double", (43 + 38 / 60 + 33.24 / 3600, -79 - 23 / 60 - 13.7 / 3600))
    found = with_utm(tower, zone=17).first()
    assert abs(found.x - 630084) < 1 and abs(found.y - 4833438) < 1
