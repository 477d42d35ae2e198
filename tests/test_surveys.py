from __future__ import annotations

from datetime import datetime

from fieldtally.plans import surveys
from fieldtally.plans.surveys import SURVEYS

VISIT = "Date string, Time string, Station string"
SITE = "Station string, Latitude double, Longitude double"
TALLY = (
    "Source string, Station string, Station2 string, Year int, Latitude double, "
    "Longitude double, N long"
)


def test_repeat_visits_count_once(frame, tuples):
    raw = frame(
        VISIT,
        *[("2018-01-05", "10:00:00", "S1")] * 3,
        *[("2018-01-05", None, "S1")] * 2,
        ("2020-13-01", "10:00:00", "S1"),
        ("2018-01-05", "10:00:00", "no site"),
        ("2018-01-05", "10:00:00", "no place"),
    )
    sites = frame(SITE, ("S1", 38.0, -121.0), ("no place", None, -121.0))
    found = surveys.summarise_survey(raw, SURVEYS["ybfmp_zoop"], sites)
    assert tuples(found, "Source", "Station", "Station2", "Year", "N", "Latitude") == [
        ("YBFMP", "S1", "S1", 2018, 2, 38.0),
        ("YBFMP", "S1", "S1", None, 1, 38.0),
    ]


def test_same_minute_is_one_visit(frame, tuples):
    raw = frame(VISIT, ("2018-01-05", "10:00:05", "S1"), ("2018-01-05", "10:00:40", "S1"))
    sites = frame(SITE, ("S1", 38.0, -121.0))
    assert tuples(surveys.summarise_survey(raw, SURVEYS["djfmp"], sites), "N") == [(1,)]
    assert tuples(surveys.summarise_survey(raw, SURVEYS["sls"], sites), "N") == [(2,)]


def test_month_first_dates(frame, tuples):
    raw = frame(VISIT, ("1/5/2018", "9:05", "S1"), ("1/6/2018", "09:05", "S1"))
    found = surveys.summarise_survey(
        raw, SURVEYS["ybfmp_fish"], frame(SITE, ("S1", 38.0, -121.0))
    )
    assert tuples(found, "Year", "N") == [(2018, 2)]


def test_own_places_are_averaged(frame, tuples):
    raw = frame(
        VISIT + ", Latitude double, Longitude double",
        ("2018-01-05", "10:00:00", "S1", 38.0, -121.0),
        ("2018-01-05", "10:00:00", "S1", 38.0, -121.0),
        ("2018-01-06", None, "S1", 38.2, -121.0),
        ("2018-01-06", None, "S1", None, -121.0),
    )
    found = surveys.summarise_survey(raw, SURVEYS["edsm"])
    assert [(r.N, round(r.Latitude, 9)) for r in found.collect()] == [(2, 38.1)]


def test_degrees_minutes_seconds(frame):
    sites = frame(
        "Station string, Lat string, Long string",
        ("1", "37 30 36", "121 30 0"),
        ("2", "37 x 36", "121 30"),
    )
    found = {r.Station: (r.Latitude, r.Longitude) for r in surveys.larval_sites(sites).collect()}
    assert found["1"] == (37.51, -121.5)
    assert found["2"] == (None, None)
    assert found["912"] == (37.966, -121.367)


def test_datasets_of_a_survey_add_up(frame, tuples):
    fish = frame(TALLY, ("YBFMP", "S", "S", 2018, 38.0, -121.0, 3))
    zoop = frame(
        TALLY, ("YBFMP", "S", "S", 2018, 38.0, -121.0, 2), ("YBFMP", "T", "T", 2018, 38.0, -121.0, 2)
    )
    other = frame(TALLY, ("YBFMP", "T", "T", 2018, 38.5, -121.0, 4))
    found = surveys.merge_datasets(fish, zoop, other)
    assert tuples(found, "Station", "Latitude", "N") == [
        ("S", 38.0, 5), ("T", 38.0, 6), ("T", 38.5, 6),
    ]


SAMPLE = (
    "Source string, Station string, Year int, Date timestamp_ntz, Datetime timestamp_ntz, "
    "Latitude double, Longitude double"
)


def day(number, hour=None):
    return datetime(2018, 1, number, hour or 0)


def test_moving_sites(frame, tuples):
    samples = frame(
        SAMPLE,
        ("EMP", "NZEZ2", 2018, day(2), day(2, 9), 38.0, -121.0),
        ("EMP", "D7", 2018, day(2), day(2, 9), 38.0, -121.0),
        ("EMP", "D7", 2018, day(3), day(3, 9), 38.0, -121.0),
        ("EMP", "A", 2018, day(2), day(2, 9), 38.0, -121.0),
        ("EMP", "A", 2018, day(2), None, 38.5, -121.0),
        ("EMP", "A", 2019, day(2), None, 38.5, -121.0),
        ("EMP", "A", 2018, day(2), day(2, 9), None, -121.0),
        ("EMP", None, None, day(2), day(2, 9), 38.0, -121.0),
    )
    found = surveys.water_quality(samples)
    assert tuples(found, "Station", "Year", "Station2", "Latitude", "N") == sorted(
        [
            ("NZEZ2", 2018, "NZEZ2 2018-01-02", 38.0, 1),
            ("D7", 2018, "D7", 38.0, 2),
            ("A", 2018, "A 2018-01-02 09:00:00", 38.0, 1),
            ("A", 2018, "A NA", 38.5, 1),
            ("A", 2019, "A", 38.5, 1),
            (None, None, None, 38.0, 1),
        ],
        key=repr,
    )
    assert {r.Parameter for r in found.collect()} == {"Water_quality"}


def test_one_place_of_many_samples_is_spread(frame, tuples):
    """Two places of a zooplankton station both carry its whole count."""
    samples = frame(
        "Source string, Station string, Date timestamp_ntz, Latitude double, Longitude double",
        *[("EMP", "Z", day(1 + i % 20), 38.0 + i % 2, -121.0) for i in range(100)],
    )
    found = surveys.zooplankton(samples)
    assert tuples(found, "Latitude", "N") == [(38.0, 100), (39.0, 100)]


def test_fish_sources(frame, tuples):
    tally = frame(
        TALLY,
        ("EMP", "S", "S", 2018, 38.0, -121.0, 3),
        ("STN", "S", "S", 2018, 38.0, -121.0, 4),
        (None, "S", "S", 2018, 38.0, -121.0, 5),
    )
    extra = frame(TALLY, ("YBFMP", "S", "S", 2018, 38.0, -121.0, 6))
    found = surveys.fish(tally, extra)
    assert tuples(found, "Source", "N", "Parameter") == [("STN", 4, "Fish"), ("YBFMP", 6, "Fish")]


def test_replicates_count_together(frame, tuples):
    samples = frame(
        "Station string, Source string, Date timestamp_ntz",
        ("D28A-L", "EMP", day(1)),
        ("D28A-R", "EMP", day(1)),
        ("D6", "EMP", day(1)),
    )
    quality = frame(
        TALLY,
        ("EMP", "D28A", "D28A", 2018, 38.0, -121.0, 3),
        ("EMP", "D28A", "D28A", 2019, 38.0, -121.0, 3),
        ("STN", "D6", "D6", 2018, 38.0, -121.0, 3),
    )
    found = surveys.benthic(samples, quality)
    assert tuples(found, "Station", "Station2", "N", "Latitude") == [
        ("D28A", "D28A", 2, 38.0), ("D6", "D6", 1, None),
    ]


def test_phytoplankton_needs_a_place(frame, tuples):
    samples = frame(
        "Station string, Source string, Date timestamp_ntz",
        ("x EZ2", "EMP", day(2)),
        ("D6", "EMP", day(2)),
    )
    quality = frame(TALLY, ("EMP", "EZ2", "EZ2 2018-01-02", 2018, 38.0, -121.0, 3))
    found = surveys.phytoplankton(samples, quality)
    assert tuples(found, "Station", "Station2", "N") == [("EZ2", "EZ2 2018-01-02", 1)]
