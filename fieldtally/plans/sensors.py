"""Sensor sites: where they are, what they measure and since when."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.projection import with_utm
from fieldtally.functions.text import paste_na, split_list
from fieldtally.operators.lookups import left_lookup
from fieldtally.operators.reshape import complete_years, explode_names
from fieldtally.operators.polygons import inside
from fieldtally.plans.names import ZONE
from fieldtally.sources.pages import (
    body_lines,
    cell,
    first_table,
    html_tables,
    lines_of,
    named_lines,
    only_table_of_width,
    table_at,
)

# Columns of the sensor sheet and of the site file.
SHEET_COLUMNS = {
    "station_name": ("station_name", "string"),
    "station_id": ("station_id", "string"),
    "sensname": ("sensname", "string"),
    "latitude": ("latitude", "double"),
    "longitude": ("longitude", "double"),
    "start_date": ("start_date", "timestamp_ntz"),
    "end_date": ("end_date", "timestamp_ntz"),
}
SITE_COLUMNS = {
    "STA": ("STA", "string"),
    "Station Name": ("Station Name", "string"),
    "Latitude": ("Latitude", "double"),
    "Longitude": ("Longitude", "double"),
    "Sensors": ("Sensors", "string"),
}

# Columns of a station page's sensor table.
METADATA_COLUMNS = [
    "Sensor Description", "Sensor Number", "Duration", "Plot", "Data Collection",
    "Data Available",
]

# The sensor list's columns in use, and how many it has.
SENSOR_LIST_COLUMNS = ["sensor num", "description"]
SENSOR_LIST_WIDTH = 5

# Fixed value: where a station page keeps its second table.
METADATA_PATH = ("main_content/div/div[1]", 2)


def in_region(places: DataFrame, edges: DataFrame, zone: int = ZONE) -> DataFrame:
    """Places inside a polygon layer that is given in the same projection."""
    return inside(with_utm(places, zone=zone), edges).drop("x", "y")


def sensor_years(
    sheet: DataFrame, edges: DataFrame, as_of_year: int, zone: int = ZONE
) -> DataFrame:
    """One row for each year in which a sensor of a station was in use. Sensors
    without an end date are in use until ``as_of_year``."""
    named = in_region(sheet.dropna(subset=["latitude", "longitude"]), edges, zone).select(
        station_label("station_name", "station_id").alias("Station"),
        F.col("latitude").alias("Latitude"),
        F.col("longitude").alias("Longitude"),
        F.col("sensname").alias("Sensor"),
        F.year("start_date").alias("start_year"),
        F.coalesce(F.year("end_date"), F.lit(as_of_year)).alias("end_year"),
    )
    keys = ["Station", "Latitude", "Longitude", "Sensor"]
    return complete_years(named, keys, "start_year", "end_year").select(
        "Station", "Latitude", "Longitude", "Year", "Sensor"
    )


def sensor_list(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Sensor numbers and descriptions from the first table of the landed list,
    whose second line names its columns."""
    tables = html_tables(pages, key, html)
    named = named_lines(tables, key, first_table(), SENSOR_LIST_COLUMNS, SENSOR_LIST_WIDTH)
    return named.select(*SENSOR_LIST_COLUMNS)


def station_sensors(
    sites: DataFrame, edges: DataFrame, sensors: DataFrame, zone: int = ZONE
) -> DataFrame:
    """Sites of the region with one row for each of their sensors."""
    listed = in_region(sites.dropna(subset=["Latitude", "Longitude"]), edges, zone).select(
        station_label("Station Name", "STA").alias("Station"),
        "Latitude",
        "Longitude",
        split_list("Sensors").alias("Sensors"),
    )
    return left_lookup(explode_names(listed, "Sensors"), sensors, {"Sensors": "sensor num"})


def station_metadata(pages: DataFrame, key: str = "Station", html: str = "html") -> DataFrame:
    """The sensor table of each landed station page, under fixed names. Pages
    without exactly one table of that width give nothing."""
    wanted = only_table_of_width(len(METADATA_COLUMNS))
    body = body_lines(lines_of(html_tables(pages, key, html), key, wanted))
    return body.select(
        key, *[cell(i).alias(name) for i, name in enumerate(METADATA_COLUMNS, start=1)]
    )


def station_tables(pages: DataFrame, key: str = "Station", html: str = "html") -> DataFrame:
    """Cells of the table at the fixed place of each landed station page."""
    lines = lines_of(html_tables(pages, key, html), key, table_at(*METADATA_PATH))
    return lines.select(key, "row_no", "cells")


def station_label(name: str, code: str):
    return paste_na(F.col(f"`{name}`"), F.lit(" ("), F.col(f"`{code}`"), F.lit(")"), sep="")
