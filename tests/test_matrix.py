from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldtally.plans import matrix
from fieldtally.plans.surveys import PARAMETERS

TALLY = (
    "Source string, Station string, Station2 string, Year int, Latitude double, "
    "Longitude double, N long, Parameter string"
)
DIRECTORY = "Station string, Zoop_station string, Benthic_station array<string>"


def row(source, station, year, n, parameter, latitude=38.0, station2=None):
    return (source, station, station2 or station, year, latitude, -121.0, n, parameter)


def test_final_names(frame, tuples):
    merged = matrix.merge_tallies(
        frame(TALLY, row("USGS", "D4", 2018, 1, "Fish")),
        frame(TALLY, row("twentymm", "NZEZ6SJR", 2018, 1, "Fish"), row("EMP", None, 2018, 1, "Fish")),
    )
    assert tuples(merged, "Source", "Station", "StationID") == [
        ("20mm", "EZ6-SJR", "20mm NZEZ6SJR"), ("EMP", None, "EMP NA"), ("SFBS", "D4", "SFBS D4"),
    ]


def test_zero_fill_maximum_and_years(frame, tuples):
    merged = matrix.merge_tallies(
        frame(
            TALLY,
            row("EMP", "D4", 2018, 3, "Fish"),
            row("EMP", "D4", 2018, 7, "Benthic", 38.2),
            row("EMP", "D4", None, 1, "Fish"),
            row("EMP", "D6", 2018, 2, "Zooplankton", None),
            row("EMP", "D6", 2019, 2, "Zooplankton"),
        )
    )
    table = matrix.effort_matrix(merged)
    assert table.columns == matrix.COLUMNS
    found = tuples(
        table.withColumn("Latitude", F.round("Latitude", 6)),
        "Station", "Year", "Fish", "Benthic", "Water_quality", "Max", "N_years", "Latitude",
    )
    assert found == [
        ("D4", 2018, 3, 7, 0, 7, 2, 38.066667),
        ("D4", None, 1, 0, 0, 1, 2, 38.066667),
        ("D6", 2018, 0, 0, 0, 2, 2, None),
        ("D6", 2019, 0, 0, 0, 2, 2, None),
    ]


def test_several_values_for_one_cell(frame, tuples):
    merged = matrix.merge_tallies(
        frame(TALLY, row("EMP", "D4", 2018, 3, "Fish"), row("EMP", "D4", 2018, 4, "Fish"))
    )
    with pytest.raises(Exception, match="more than one N for Fish"):
        matrix.effort_matrix(merged).collect()
    assert tuples(matrix.effort_matrix(merged, on_duplicate="sum"), "Fish") == [(7,)]
    assert tuples(matrix.effort_matrix(merged, on_duplicate="max"), "Fish") == [(4,)]
    with pytest.raises(ValueError, match="on_duplicate"):
        matrix.effort_matrix(merged, on_duplicate="first")


@pytest.mark.parametrize(
    ("zoop", "benthic", "expected"),
    [
        (None, None, None),
        (None, ["D4-L", "D4-R"], "Benthic: D4-L, D4-R"),
        ("Z1", None, "Zooplankton: Z1"),
        ("Z1", ["D4-L", "D4-R"], "Benthic: D4-L, D4-R | Zooplankton: Z1"),
    ],
)
def test_extra_label(frame, zoop, benthic, expected):
    directory = frame(DIRECTORY, ("D4", zoop, benthic))
    merged = matrix.merge_tallies(frame(TALLY, row("EMP", "D4", 2018, 3, "Fish")))
    assert matrix.effort_matrix(merged, directory).first().Extra_stations == expected


def test_columns_give_back_the_tallies(frame, tuples):
    rows = [
        row("EMP", f"D{i % 7}", 2010 + i % 3, i + 1, PARAMETERS[i // 21 % 5]) for i in range(105)
    ]
    merged = matrix.merge_tallies(frame(TALLY, *rows))
    table = matrix.effort_matrix(merged)
    long = table.unpivot(["StationID", "Year"], PARAMETERS, "Parameter", "N").filter("N > 0")
    columns = ("StationID", "Year", "Parameter", "N")
    assert tuples(long, *columns) == tuples(merged, *columns)


def test_conflicts(frame, tuples):
    merged = matrix.merge_tallies(
        frame(
            TALLY,
            row("EMP", "D4", 2018, 3, "Fish"),
            row("EMP", "D4", 2019, 3, "Fish", 38.5),
            row("EMP", "D4", 2020, 3, "Fish", 38.2),
            row("EMP", "D6", 2018, 3, "Fish"),
        )
    )
    assert tuples(matrix.coordinate_conflicts(merged)) == [("EMP D4", 3)]
    assert tuples(matrix.conflict_report(merged), "Latitude", "N_places") == [
        (38.0, 3), (38.2, 3), (38.5, 3)
    ]
    assert tuples(matrix.conflicting_places(merged), "Latitude") == [(38.0,), (38.2,), (38.5,)]


def test_years_of_a_site_merge_across_runs(frame, tuples):
    def merged(*years):
        return matrix.merge_tallies(frame(TALLY, *[row("EMP", "D4", y, 1, "Fish") for y in years]))

    runs = [matrix.site_years(merged(2018, 2019, 2018)), matrix.site_years(merged(2019, None, 1950))]
    both = matrix.merge_site_years(*runs, matrix.site_years(merged(None)))
    counted = both.select("StationID", matrix.year_count().alias("n"))
    assert tuples(counted) == [("EMP D4", 4)]
    assert tuples(matrix.effort_matrix(merged(2018, 2019, None, 1950)), "N_years") == [(4,)] * 4


def test_effort_needs_one_shuffle(frame):
    merged = matrix.merge_tallies(frame(TALLY, row("EMP", "D4", 2018, 3, "Fish")))
    plan = matrix.effort_matrix(merged)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
