"""From raw visit records to yearly sample counts, survey by survey.

A tally has the columns Source, Station, Station2, Year, Latitude, Longitude, N
and, once it is assigned to one, Parameter."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.numbers import sexagesimal
from fieldtally.functions.text import (
    date_text,
    datetime_text,
    first_containing,
    paste_na,
    split_part,
)
from fieldtally.functions.times import parse_date, parse_datetime, to_minute
from fieldtally.operators.lookups import in_list, left_lookup, with_coordinates
from fieldtally.operators.tallies import (
    count_at_each_place,
    count_rows,
    count_with_mean_place,
    distinct_values,
    split_moving,
    stack,
)
from fieldtally.sources.tables import rows

# Parameter names.
PARAMETERS = ["Benthic", "Phytoplankton", "Zooplankton", "Water_quality", "Fish"]

# Fixed value: a station whose name holds this text has no fixed place.
UNFIXED = "EZ"

# Sources read from the integrated water quality table, those of
# them that catch fish, and the years asked of the integrated tables.
WATER_QUALITY_SOURCES = [
    "EMP", "STN", "FMWT", "DJFMP", "SKT", "20mm", "Suisun", "Baystudy", "USBR", "USGS",
]
FISH_SOURCES = ["STN", "FMWT", "EDSM", "DJFMP", "SKT", "20mm", "Suisun", "Baystudy", "SLS"]
FIRST_YEAR = 1950
LAST_YEAR = 2021

# Phytoplankton station names, the longer ones first.
PHYTOPLANKTON_NAMES = ["EZ6 SJR", "EZ2 SJR", "EZ2", "EZ6"]

# Fixed value: a larval survey station absent from its site table.
MISSING_LARVAL_SITES = [("912", 37.966, -121.367)]

YEARLY = ["Station", "Year", "Source"]
LABELLED = ["Year", "Station", "Station2", "Source"]


@dataclass(frozen=True)
class Survey:
    """How one survey's visit file is read."""

    source: str
    columns: dict[str, tuple[str, str]]
    date_form: str = "ymd"
    time_form: str = "seconds"
    whole_minutes: bool = False
    own_places: bool = False
    sites: dict[str, tuple[str, str]] = field(default_factory=dict)


def _text(**names: str) -> dict[str, tuple[str, str]]:
    return {old: (new, "string") for new, old in names.items()}


def _site(station: str, latitude: str, longitude: str) -> dict[str, tuple[str, str]]:
    return {
        station: ("Station", "string"),
        latitude: ("Latitude", "double"),
        longitude: ("Longitude", "double"),
    }


# Column names and date forms of the survey files.
SURVEYS = {
    "ybfmp_zoop": Survey(
        "YBFMP",
        _text(Date="Date", Time="Time", Station="StationCode"),
        sites=_site("StationCode", "Latitude", "Longitude"),
    ),
    "edsm": Survey(
        "EDSM",
        {
            **_text(Date="Date", Time="Time", Station="Station"),
            "TargetLat": ("Latitude", "double"),
            "TargetLong": ("Longitude", "double"),
        },
        own_places=True,
    ),
    "djfmp": Survey(
        "DJFMP",
        _text(Station="StationCode", Date="SampleDate", Time="SampleTime"),
        whole_minutes=True,
        sites=_site("StationCode", "Latitude_location", "Longitude_location"),
    ),
    "ybfmp_fish": Survey(
        "YBFMP",
        _text(Date="SampleDate", Time="SampleTime", Station="StationCode"),
        date_form="mdy",
        time_form="minutes",
        sites=_site("StationCode", "LatitudeLocation", "LongitudeLocation"),
    ),
    "sls": Survey(
        "SLS",
        _text(Date="Date", Time="Time", Station="Station"),
        sites=_text(Station="Station", Lat="Lat", Long="Long"),
    ),
}


def named(table: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Pick and rename the file columns of a table that was read some other way
    than from CSV."""
    return table.select(*[F.col(f"`{old}`").alias(new) for old, (new, _) in columns.items()])


def visits(raw: DataFrame, survey: Survey) -> DataFrame:
    """Parsed visits, each sample once. ``raw`` has Date, Time and Station as
    text. Only the columns that tell samples apart are shuffled."""
    moment = parse_datetime(F.col("Date"), F.col("Time"), survey.date_form, survey.time_form)
    places = ["Latitude", "Longitude"] if survey.own_places else []
    parsed = raw.select(
        "Station",
        *places,
        parse_date(F.col("Date"), survey.date_form).alias("Date"),
        (to_minute(moment) if survey.whole_minutes else moment).alias("Datetime"),
    )
    return (
        parsed.distinct()
        .withColumn("Source", F.lit(survey.source))
        .withColumn("Year", F.year("Date"))
    )


def summarise_survey(raw: DataFrame, survey: Survey, sites: DataFrame | None = None) -> DataFrame:
    """Yearly counts of a survey whose sites are placed by a site table, or,
    with ``own_places``, by the mean of the places in its visits. Counting comes
    before the lookup, so the join sees one row per station and year."""
    if survey.own_places:
        placed = visits(with_coordinates(raw), survey).withColumn("Station2", F.col("Station"))
        return count_with_mean_place(placed, LABELLED)
    counts = count_rows(visits(raw, survey), YEARLY)
    located = with_coordinates(left_lookup(counts, sites, ["Station"]))
    return located.withColumn("Station2", F.col("Station"))


def larval_sites(sites: DataFrame) -> DataFrame:
    """Places given as degrees, minutes and seconds, longitudes counted to the
    west, and the site that is missing from the file."""

    def decimal(column: str) -> Column:
        parts = [split_part(column, " ", i).try_cast("double") for i in (1, 2, 3)]
        return sexagesimal(*parts)

    places = sites.select(
        "Station", decimal("Lat").alias("Latitude"), (-decimal("Long")).alias("Longitude")
    )
    missing = rows(
        sites.sparkSession,
        MISSING_LARVAL_SITES,
        "Station string, Latitude double, Longitude double",
    )
    return stack(places, missing)


def merge_datasets(*tallies: DataFrame) -> DataFrame:
    """Several datasets of one survey: counts of a station and year are added."""
    return count_at_each_place(stack(*tallies), ["Station", "Year", "Source", "Station2"], "N")


def dated_label(station: Column, date: Column) -> Column:
    """Station names, with the date added where the place is not fixed."""
    return F.when(station.contains(UNFIXED), paste_na(station, date_text(date))).otherwise(station)


def zooplankton(samples: DataFrame, *tallies: DataFrame) -> DataFrame:
    """Counts of the integrated zooplankton samples, and further survey tallies."""
    labelled = with_coordinates(samples).select(
        F.year("Date").alias("Year"),
        "Station",
        dated_label(F.col("Station"), F.col("Date")).alias("Station2"),
        "Source",
        "Latitude",
        "Longitude",
    )
    return with_zooplankton(count_at_each_place(labelled, LABELLED), *tallies)


def with_zooplankton(counted: DataFrame, *tallies: DataFrame) -> DataFrame:
    """Further survey tallies beside the counts of the integrated samples."""
    return stack(counted, *tallies).withColumn("Parameter", F.lit("Zooplankton"))


def water_quality(samples: DataFrame, *tallies: DataFrame) -> DataFrame:
    """Counts of the integrated water quality samples, and further tallies. Where
    the places of a station differ within a year, its samples are told apart by
    date and time."""
    labelled = with_coordinates(samples).select(
        "Year",
        "Station",
        dated_label(F.col("Station"), F.col("Date")).alias("Station2"),
        "Source",
        "Latitude",
        "Longitude",
        "Datetime",
    )
    by_moment = paste_na("Station2", datetime_text("Datetime"))
    counted = split_moving(labelled, LABELLED, "Station2", by_moment)
    return stack(counted, *tallies).withColumn("Parameter", F.lit("Water_quality"))


def fish(water_quality_tally: DataFrame, *tallies: DataFrame) -> DataFrame:
    """Fish samples: the water quality samples of fish surveys, and further
    tallies."""
    caught = water_quality_tally.filter(in_list("Source", FISH_SOURCES))
    return stack(caught, *tallies).withColumn("Parameter", F.lit("Fish"))


def benthic(samples: DataFrame, water_quality_tally: DataFrame) -> DataFrame:
    """Replicates of a station (a suffix after a dash) count together; places
    come from the water quality sites and may stay unknown."""
    folded = samples.select(
        F.year("Date").alias("Year"), split_part("Station", "-", 1).alias("Station"), "Source"
    ).withColumn("Station2", F.col("Station"))
    counted = count_rows(folded, LABELLED).withColumn("Parameter", F.lit("Benthic"))
    return left_lookup(counted, _emp_places(water_quality_tally, "Station"), ["Station"])


def phytoplankton(samples: DataFrame, water_quality_tally: DataFrame) -> DataFrame:
    """Folded station names, with the date where the place is not fixed; only
    samples with a known place."""
    labelled = (
        samples.select("Station", "Date", "Source")
        .withColumn("Station", first_containing("Station", PHYTOPLANKTON_NAMES))
        .select(
            F.year("Date").alias("Year"),
            "Station",
            dated_label(F.col("Station"), F.col("Date")).alias("Station2"),
            "Source",
        )
    )
    counted = count_rows(labelled, LABELLED).withColumn("Parameter", F.lit("Phytoplankton"))
    keys = ["Station", "Station2"]
    return with_coordinates(left_lookup(counted, _emp_places(water_quality_tally, *keys), keys))


def _emp_places(water_quality_tally: DataFrame, *keys: str) -> DataFrame:
    emp = water_quality_tally.filter(F.col("Source") == "EMP")
    return distinct_values(emp, *keys, "Latitude", "Longitude")
