"""The sampling-effort table: one row per station and year, one column per
parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions.text import paste_na, recode
from fieldtally.operators.lookups import keep_matching, left_lookup
from fieldtally.operators.reshape import wide_count
from fieldtally.operators.tallies import COORDINATES, distinct_values, stack
from fieldtally.plans.surveys import PARAMETERS

# Final names of sources and of sites without a fixed place.
SOURCE_NAMES = {"twentymm": "20mm", "USGS": "SFBS", "USBR": "SDSCS"}
STATION_NAMES = {
    "NZEZ2": "EZ2", "NZEZ6": "EZ6", "NZEZ2SJR": "EZ2-SJR", "NZEZ6SJR": "EZ6-SJR",
}

# The last year that a bitmap of one bucket holds stands for a missing one.
MISSING_YEAR = 32768

ROW = ["Year", "Station", "Station2", "Source", "StationID"]
COLUMNS = [
    "Year", "Station", "Station2", "Source", "Latitude", "Longitude", "StationID", "N_years",
    *PARAMETERS, "Zoop_station", "Benthic_station", "Max", "Extra_stations",
]


def merge_tallies(
    *tallies: DataFrame,
    source_names: dict[str, str] = SOURCE_NAMES,
    station_names: dict[str, str] = STATION_NAMES,
) -> DataFrame:
    """All tallies under their final names, with a StationID."""
    return (
        stack(*tallies)
        .withColumn("Source", recode("Source", source_names))
        .withColumn("Station", recode("Station", station_names))
        .withColumn("StationID", paste_na("Source", "Station2"))
    )


def effort_matrix(
    merged: DataFrame, directory: DataFrame | None = None, on_duplicate: str = "error"
) -> DataFrame:
    """The final table from merged tallies and the alias directory.

    Tallies are aggregates already, with one row per station, year, parameter and place,
    so one shuffle by StationID serves both steps: the parameters become columns, with
    the coordinates carried along as sums, and means and year counts of a StationID are
    taken in a window over its rows, about one per year."""
    wide = merged.repartition("StationID").groupBy(*ROW).agg(
        *[wide_count("Parameter", p, "N", on_duplicate).alias(p) for p in PARAMETERS],
        *[F.sum(c).alias(f"sum_{c}") for c in COORDINATES],
        *[F.count(c).alias(f"known_{c}") for c in COORDINATES],
        F.count("*").alias("tallied"),
    )
    station = Window.partitionBy("StationID")
    table = wide.select(
        *ROW,
        *[_mean_over(c, station).alias(c) for c in COORDINATES],
        _years_over(station).alias("N_years"),
        *PARAMETERS,
    )
    if directory is None:
        table = table.withColumns(
            {
                "Zoop_station": F.lit(None).cast("string"),
                "Benthic_station": F.lit(None).cast("array<string>"),
            }
        )
    else:
        table = left_lookup(table, directory, ["Station"])
    return table.withColumns(
        {"Max": F.greatest(*PARAMETERS), "Extra_stations": extra_label()}
    ).select(*COLUMNS)


def extra_label() -> Column:
    """Other names of a station as text, null if there are none."""
    benthic = F.concat(F.lit("Benthic: "), F.array_join("Benthic_station", ", "))
    zooplankton = F.concat(F.lit("Zooplankton: "), F.col("Zoop_station"))
    return F.nullif(F.concat_ws(" | ", benthic, zooplankton), F.lit(""))


def coordinate_conflicts(merged: DataFrame) -> DataFrame:
    """Sites with more than one place, and how many. The places themselves are given
    by :func:`conflicting_places`."""
    return (
        distinct_values(merged, "StationID", *COORDINATES)
        .groupBy("StationID")
        .agg(F.count("*").alias("N_places"))
        .filter(F.col("N_places") > 1)
    )


def conflicting_places(merged: DataFrame) -> DataFrame:
    """Every place of the sites that have more than one."""
    places = distinct_values(merged, "StationID", *COORDINATES)
    return keep_matching(places, coordinate_conflicts(merged), ["StationID"])


def conflict_report(merged: DataFrame) -> DataFrame:
    """One row for each place of such a site, with the site's number of places."""
    places = distinct_values(merged, "StationID", *COORDINATES)
    conflicts = coordinate_conflicts(merged)
    return left_lookup(keep_matching(places, conflicts, ["StationID"]), conflicts, ["StationID"])


def _mean_over(column: str, station) -> Column:
    """Mean over a station's tallies; unknown as soon as one place is unknown."""
    known = F.sum(f"known_{column}").over(station)
    complete = known == F.sum("tallied").over(station)
    return F.when(complete, F.sum(f"sum_{column}").over(station) / known)


def _years_over(station) -> Column:
    """Distinct years of a station."""
    return F.bitmap_count(_year_bits().over(station))


def site_years(merged: DataFrame) -> DataFrame:
    """``StationID, years``: the years of each site as a bitmap, which later runs add to
    with :func:`merge_site_years` and :func:`year_count` counts."""
    return merged.groupBy("StationID").agg(_year_bits().alias("years"))


def merge_site_years(*parts: DataFrame) -> DataFrame:
    """Bitmaps of several runs in one; no visit is read again."""
    return stack(*parts).groupBy("StationID").agg(F.bitmap_or_agg("years").alias("years"))


def year_count(years: str = "years") -> Column:
    return F.bitmap_count(years)


def _year_bits() -> Column:
    """Bitmap of the years of a group. A missing year has the last bit, of a year that
    no calendar here reaches."""
    year = F.coalesce(F.col("Year").cast("long"), F.lit(MISSING_YEAR))
    return F.bitmap_construct_agg(F.bitmap_bit_position(year))
