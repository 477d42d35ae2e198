from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.plans import names

TALLY = (
    "Source string, Station string, Station2 string, Year int, Latitude double, "
    "Longitude double, N long"
)
METRE = 1 / 110990.0  # degrees of latitude near 38 north, as projected


def sites(frame, *rows):
    return frame("Source string, Station string, Latitude double, Longitude double", *rows)


def test_matches_within_the_radius(frame, tuples):
    zoop = sites(
        frame,
        ("EMP", "near", 38.0 + 990 * METRE, -123.0),
        ("EMP", "far", 38.0 + 1010 * METRE, -123.0),
        ("EMP", "unknown", None, -123.0),
        ("FMWT", "other", 38.0, -123.0),
    )
    quality = frame(
        TALLY,
        ("EMP", "D4", "D4", 2018, 38.0, -123.0, 3),
        ("EMP", "NZEZ2", "NZEZ2", 2018, 38.0 + 980 * METRE, -123.0, 3),
        ("STN", "T", "T", 2018, 38.0 + 980 * METRE, -123.0, 3),
    )
    found = names.match_sites(zoop, quality)
    assert tuples(found, "Source", "Station", "WQ_station", "WQ_lat") == [
        ("EMP", "near", "D4", 38.0)
    ]
    assert abs(found.first().Distance - 990) < 5
    wider = names.match_sites(zoop, quality, radius=2000.0)
    assert tuples(wider, "Station") == [("far",), ("near",)]


def test_matched_station_takes_the_place_of_the_other(frame, tuples):
    tally = frame(
        TALLY,
        ("EMP", "near", "near", 2018, 38.1, -121.0, 3),
        ("EMP", "own", "own x", 2018, 38.2, -121.0, 4),
        ("FMWT", "near", "near", 2018, 38.3, -121.0, 5),
    )
    matches = frame(
        "Source string, Station string, WQ_station string, WQ_lat double, WQ_lon double",
        ("EMP", "near", "D4", 38.0, -121.5),
    )
    found = names.harmonise(tally, matches)
    assert tuples(found, "Source", "Station", "Station2", "Latitude", "Longitude", "N") == [
        ("EMP", "D4", "D4", 38.0, -121.5, 3),
        ("EMP", "own", "own x", 38.2, -121.0, 4),
        ("FMWT", "near", "near", 38.3, -121.0, 5),
    ]


def test_directory_of_names(frame, tuples):
    matches = frame(
        "Source string, Station string, WQ_station string", ("EMP", "Z1", "D4"), ("EMP", "Z2", "D9")
    )
    benthic = frame("Station string", ("D4-R",), ("D4-L",), ("D4-L",), ("D6",))
    found = names.alias_directory(matches, benthic).withColumn(
        "Benthic_station", F.array_join("Benthic_station", ",")
    )
    assert tuples(found, "Station", "Zoop_station", "Benthic_station") == [
        ("D4", "Z1", "D4-L,D4-R"), ("D6", None, "D6-NA"), ("D9", "Z2", None),
    ]
