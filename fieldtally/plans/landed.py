"""Input tables as they lie in a landing folder: files of the surveys and sheets
as CSV, integrated tables, polygon rings and pages as Parquet."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from fieldtally.operators.polygons import ring_edges
from fieldtally.plans.explore import SURVEY_SHEET_COLUMNS
from fieldtally.plans.sensors import SHEET_COLUMNS, SITE_COLUMNS
from fieldtally.plans.surveys import SURVEYS
from fieldtally.sources.tables import read_csv, read_table

# File names and the columns read from each file.
CSV_FILES = {
    "ybfmp_zoop": SURVEYS["ybfmp_zoop"].columns,
    "ybfmp_zoop_sites": SURVEYS["ybfmp_zoop"].sites,
    "edsm_20mm": SURVEYS["edsm"].columns,
    "edsm_kdtr": SURVEYS["edsm"].columns,
    "djfmp_seine": SURVEYS["djfmp"].columns,
    "djfmp_sites": SURVEYS["djfmp"].sites,
    "ybfmp_fish": SURVEYS["ybfmp_fish"].columns,
    "ybfmp_fish_sites": SURVEYS["ybfmp_fish"].sites,
    "sls_fish": SURVEYS["sls"].columns,
    "sls_sites": SURVEYS["sls"].sites,
    "sensor_sheet": SHEET_COLUMNS,
    "cdec_sites": SITE_COLUMNS,
    "survey_sheet": SURVEY_SHEET_COLUMNS,
}
PARQUET_FILES = {
    "zoop_env": ["Station", "Source", "Date", "Latitude", "Longitude"],
    "zoop_sites": ["Source", "Station", "Latitude", "Longitude"],
    "water_quality": [
        "Source", "Station", "Year", "Date", "Datetime", "Latitude", "Longitude",
    ],
    "bivalves": ["Date", "Station", "Source"],
    "phytoplankton": ["Date", "Station", "Source"],
    "subregions": ["poly_id", "ring_id", "seq", "x", "y"],
    "sensor_page": ["page", "html"],
    "site_pages": ["Station", "html"],
}


class Landed(Mapping):
    """Tables of a landing folder by name; each is a pruned scan. CSV files may be files
    or folders of files, whose headers are read when they are asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getitem__(self, name: str) -> DataFrame:
        if name in CSV_FILES:
            return read_csv(self.spark, f"{self.folder}/{name}.csv", CSV_FILES[name])
        return read_table(self.spark, f"{self.folder}/{name}.parquet", *PARQUET_FILES[name])

    def __iter__(self) -> Iterator[str]:
        return iter([*CSV_FILES, *PARQUET_FILES])

    def __len__(self) -> int:
        return len(CSV_FILES) + len(PARQUET_FILES)

    def region_edges(self) -> DataFrame:
        return ring_edges(self["subregions"])
