"""Build the effort table and the sensor tables from a landing folder:

    python -m fieldtally <landing folder> <result folder> [--as-of YEAR]
        [--on-duplicate error|sum|max] [--shared FOLDER]

Before the work begins, site pairs that would give one cell of the effort table
several values are looked for; with ``error`` they are reported and nothing is built.
``spark.checkpoint.dir``, or ``--shared``, names a folder that all executors share."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import SparkSession

from fieldtally.plans.build import sampling_table
from fieldtally.plans.explore import station_alias, survey_info
from fieldtally.plans.landed import Landed
from fieldtally.plans.sensors import sensor_list, sensor_years, station_metadata, station_sensors
from fieldtally.sources.tables import read_sampling, write_sampling


def build(
    spark: SparkSession, landing: str, results: str, as_of_year: int, on_duplicate: str = "error"
) -> None:
    landed = Landed(spark, landing)
    write_sampling(sampling_table(landed, on_duplicate), f"{results}/sampling")
    sampling = read_sampling(spark, f"{results}/sampling")
    edges = landed.region_edges()
    sensors = sensor_list(landed["sensor_page"], "page", "html")
    tables = {
        "station_alias": station_alias(sampling),
        "survey_info": survey_info(landed["survey_sheet"], sampling),
        "sensor_years": sensor_years(landed["sensor_sheet"], edges, as_of_year),
        "station_sensors": station_sensors(landed["cdec_sites"], edges, sensors),
        "station_metadata": station_metadata(landed["site_pages"]),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{results}/{name}")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fieldtally")
    parser.add_argument("landing")
    parser.add_argument("results")
    parser.add_argument("--as-of", type=int, default=date.today().year)
    parser.add_argument("--on-duplicate", choices=["error", "sum", "max"], default="error")
    parser.add_argument("--shared", help="where spark.checkpoint.dir is unset")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("fieldtally").getOrCreate()
    if given.shared:
        spark.sparkContext.setCheckpointDir(given.shared)
    build(spark, given.landing, given.results, given.as_of, given.on_duplicate)


if __name__ == "__main__":
    main()
