"""Station names: matching of zooplankton to water quality sites, and the
directory of the names a station has elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.projection import with_utm
from fieldtally.functions.text import paste_na, split_part
from fieldtally.operators.lookups import full_directory, left_lookup, with_coordinates
from fieldtally.operators.spatial import nearest
from fieldtally.operators.tallies import collect_names, distinct_values
from fieldtally.plans.surveys import UNFIXED

# The matched survey, the radius in metres and the grid zone.
MATCHED_SOURCE = "EMP"
MATCH_RADIUS = 1000.0
ZONE = 10


def match_sites(
    zooplankton_sites: DataFrame,
    water_quality_tally: DataFrame,
    radius: float = MATCH_RADIUS,
    zone: int = ZONE,
) -> DataFrame:
    """The nearest fixed water quality station of each zooplankton station, if it
    is near enough: Source, Station, Distance, WQ_station, WQ_lat, WQ_lon. A
    station recorded at several places gives a row for each."""
    sites = with_coordinates(zooplankton_sites.filter(F.col("Source") == MATCHED_SOURCE))
    targets = distinct_values(
        water_quality_tally.filter(
            (F.col("Source") == MATCHED_SOURCE) & ~F.col("Station").contains(UNFIXED)
        ),
        "Station",
        "Latitude",
        "Longitude",
    )
    found = nearest(
        with_utm(sites, zone=zone), with_utm(targets, zone=zone), "Station", max_distance=radius
    )
    matched = found.filter(F.col("distance") <= radius).select(
        F.lit(MATCHED_SOURCE).alias("Source"),
        "Station",
        F.col("distance").alias("Distance"),
        F.col("nearest_id").alias("WQ_station"),
    )
    places = targets.select(
        "Station", F.col("Latitude").alias("WQ_lat"), F.col("Longitude").alias("WQ_lon")
    )
    return left_lookup(matched, places, {"WQ_station": "Station"})


def harmonise(zooplankton_tally: DataFrame, matches: DataFrame) -> DataFrame:
    """Name and place of the water quality station wherever there is a match."""
    renamed = left_lookup(
        zooplankton_tally,
        matches.select("Source", "Station", "WQ_station", "WQ_lat", "WQ_lon"),
        ["Source", "Station"],
    )
    own = F.col("WQ_station").isNull()
    changes = {
        "Station": "WQ_station",
        "Station2": "WQ_station",
        "Latitude": "WQ_lat",
        "Longitude": "WQ_lon",
    }
    return renamed.withColumns(
        {name: F.when(own, F.col(name)).otherwise(F.col(other)) for name, other in changes.items()}
    ).drop("WQ_station", "WQ_lat", "WQ_lon")


def alias_directory(matches: DataFrame, benthic_samples: DataFrame) -> DataFrame:
    """Station, its zooplankton name and the array of its benthic names."""
    zooplankton_names = distinct_values(matches, "Station", "WQ_station").select(
        F.col("WQ_station").alias("Station"), F.col("Station").alias("Zoop_station")
    )
    names = distinct_values(benthic_samples, "Station").select(
        split_part("Station", "-", 1).alias("Station"),
        paste_na(split_part("Station", "-", 1), split_part("Station", "-", 2), sep="-").alias(
            "Benthic_station"
        ),
    )
    return full_directory(
        zooplankton_names, collect_names(names, "Station", "Benthic_station"), "Station"
    )
