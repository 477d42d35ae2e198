"""Survey inputs derived from the test tables. Each is a projection of one whole
table, written in the SQL that Spark and DuckDB share, so that both sides start
from the same rows."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Input:
    table: str
    columns: dict[str, str]
    where: str = "true"


def latitude(key: str) -> str:
    return f"(cast(37.5 as double) + ({key} * 37 % 1009) / cast(1009 as double))"


def longitude(key: str) -> str:
    return f"(cast(-122.5 as double) + ({key} * 91 % 1511) / cast(1007 as double))"


def text(value: str) -> str:
    return f"cast({value} as string)"


def padded(value: str) -> str:
    return f"lpad({text(value)}, 2, '0')"


def day(moment: str) -> str:
    return text(f"cast({moment} as date)")


def shifted(value: str, step: str) -> str:
    return f"({value} + ({step}) * cast(0.01 as double))"


LINE_DATE = f"case when l_partkey % 97 = 0 then '2020-13-01' else {day('l_shipdate')} end"
LINE_TIME = (
    "case when l_partkey % 11 = 0 then null else "
    f"{padded('l_partkey % 24')} || ':' || {padded('l_linenumber * 7')} || ':' || "
    f"{padded('l_orderkey % 60')} end"
)
ORDER_TIME = f"{padded('o_orderkey % 24')} || ':' || {padded('o_orderkey * 7 % 60')}"
ORDER_MOMENT = f"cast({day('o_orderdate')} || ' ' || {ORDER_TIME} || ':00' as TIMESTAMP_TYPE)"

SITE = {
    "Latitude": latitude("s_suppkey"),
    "Longitude": longitude("s_suppkey"),
}

# The surveys, parameters and sites that stand in for the test
# tables' own values.
SEGMENT_SOURCE = (
    "case c_mktsegment when 'AUTOMOBILE' then 'EMP' when 'BUILDING' then 'EDSM' "
    "when 'FURNITURE' then 'FMWT' when 'HOUSEHOLD' then '20mm' else 'Suisun' end"
)
PRIORITY_PARAMETER = (
    "case substr(o_orderpriority, 1, 1) when '1' then 'Benthic' when '2' then 'Phytoplankton' "
    "when '3' then 'Zooplankton' when '4' then 'Water_quality' else 'Fish' end"
)
WATER_SOURCE = (
    "case o_custkey % 6 when 0 then 'EMP' when 1 then 'USGS' when 2 then 'FMWT' "
    "when 3 then 'USBR' when 4 then '20mm' else 'unlisted' end"
)
UNFIXED_WATER = (
    "case o_custkey % 120 when 18 then 'NZEZ2' when 24 then 'NZEZ6' when 30 then 'NZEZ2SJR' "
    f"when 36 then 'NZEZ6SJR' else 'W' || {text('o_custkey')} end"
)

INPUTS = {
    "ybfmp_zoop": Input(
        "lineitem",
        {"Date": LINE_DATE, "Time": LINE_TIME, "Station": f"'Y' || {text('l_suppkey')}"},
    ),
    "ybfmp_zoop_sites": Input(
        "supplier",
        {
            "Station": f"'Y' || {text('s_suppkey')}",
            "Latitude": f"case when s_suppkey % 13 = 0 then null else {SITE['Latitude']} end",
            "Longitude": SITE["Longitude"],
        },
    ),
    "edsm_20mm": Input(
        "orders",
        {
            "Date": day("o_orderdate"),
            "Time": f"{ORDER_TIME} || ':00'",
            "Station": f"'E' || {text('o_custkey')}",
            "Latitude": latitude("o_orderkey"),
            "Longitude": f"case when o_orderkey % 17 = 0 then null else {longitude('o_orderkey')} end",
        },
        "o_orderkey % 2 = 0",
    ),
    "edsm_kdtr": Input(
        "orders",
        {
            "Date": day("o_orderdate"),
            "Time": f"case when o_orderkey % 3 = 0 then null else {ORDER_TIME} || ':00' end",
            "Station": f"'E' || {text('o_custkey')}",
            "Latitude": latitude("o_orderkey"),
            "Longitude": longitude("o_orderkey"),
        },
        "o_orderkey % 2 = 1",
    ),
    "djfmp_seine": Input(
        "lineitem",
        {"Station": f"'J' || {text('l_suppkey')}", "Date": LINE_DATE, "Time": LINE_TIME},
    ),
    "djfmp_sites": Input("supplier", {"Station": f"'J' || {text('s_suppkey')}", **SITE}),
    "ybfmp_fish": Input(
        "orders",
        {
            "Date": f"{text('month(o_orderdate)')} || '/' || {text('day(o_orderdate)')} || '/' || "
            f"{text('year(o_orderdate)')}",
            "Time": f"case when o_orderkey % 5 = 0 then null else {ORDER_TIME} end",
            "Station": f"'Y' || {text('o_custkey')}",
        },
    ),
    "ybfmp_fish_sites": Input(
        "lineitem",
        {
            "Station": f"'Y' || {text('l_suppkey')}",
            "Latitude": shifted(latitude("l_suppkey"), "case when l_suppkey % 5 = 0 then 1 else 0 end"),
            "Longitude": longitude("l_suppkey"),
        },
    ),
    "sls_fish": Input(
        "lineitem",
        {"Date": LINE_DATE, "Time": LINE_TIME, "Station": text("900 + l_suppkey")},
    ),
    "sls_sites": Input(
        "supplier",
        {
            "Station": text("900 + s_suppkey"),
            "Lat": "case when s_suppkey = 12 then null else "
            f"'37 ' || {text('s_suppkey % 60')} || ' ' || {text('s_suppkey * 7 % 60')} end",
            "Long": f"'121 ' || {text('s_suppkey * 11 % 60')} || ' ' || {text('s_suppkey % 50')}",
        },
    ),
    "zoop_env": Input(
        "lineitem",
        {
            "Station": "case l_suppkey % 25 when 3 then 'NZEZ2' when 4 then 'NZEZ6SJR' else "
            f"'Z' || {text('l_suppkey')} end",
            "Source": "case when l_linenumber <= 2 then 'EMP' when l_linenumber <= 4 then 'twentymm' "
            "else 'FMWT' end",
            "Date": "l_shipdate",
            "Latitude": f"case when l_partkey % 31 = 0 then null else {latitude('l_suppkey')} end",
            "Longitude": shifted(
                longitude("l_suppkey"), "case when l_suppkey % 9 = 0 then l_partkey % 2 else 0 end"
            ),
        },
    ),
    "zoop_sites": Input(
        "supplier",
        {
            "Source": "case when s_suppkey % 10 = 9 then 'FMWT' else 'EMP' end",
            "Station": f"'Z' || {text('s_suppkey')}",
            "Latitude": f"({SITE['Latitude']} + (s_suppkey % 7) * cast(0.002 as double))",
            "Longitude": SITE["Longitude"],
        },
    ),
    "water_quality": Input(
        "orders",
        {
            "Source": WATER_SOURCE,
            "Station": UNFIXED_WATER,
            "Year": "cast(year(o_orderdate) + case when o_custkey % 50 = 7 then 25 else 0 end as int)",
            "Date": "o_orderdate",
            "Datetime": f"case when o_orderkey % 13 = 0 then null else {ORDER_MOMENT} end",
            "Latitude": f"case when o_orderkey % 19 = 0 then null else {latitude('o_custkey')} end",
            "Longitude": shifted(
                longitude("o_custkey"), "case when o_custkey % 4 = 0 then o_orderkey % 2 else 0 end"
            ),
        },
    ),
    "bivalves": Input(
        "lineitem",
        {
            "Station": f"'W' || {text('l_suppkey')} || case l_linenumber % 4 when 0 then '-L' "
            "when 1 then '-R' when 2 then '-C' else '' end",
            "Source": "'EMP'",
            "Date": "l_shipdate",
        },
    ),
    "phytoplankton": Input(
        "orders",
        {
            "Station": "case o_custkey % 60 when 6 then 'NZ EZ2 SJR' when 12 then 'EZ2 x' "
            f"when 18 then 'y EZ6' else 'W' || {text('o_custkey')} end",
            "Source": "'EMP'",
            "Date": "o_orderdate",
        },
    ),
    "sensor_sheet": Input(
        "orders",
        {
            "station_name": f"'Station ' || {text('o_custkey')}",
            "station_id": f"'S' || {text('o_custkey')}",
            "latitude": latitude("o_custkey"),
            "longitude": longitude("o_custkey"),
            "sensname": f"'sensor ' || {text('o_orderkey % 2')}",
            "start_date": "o_orderdate",
            "end_date": "case when o_orderkey % 7 = 0 then null when o_orderkey % 3 = 0 then "
            f"cast({text('year(o_orderdate) + 2')} || '-01-01' as TIMESTAMP_TYPE) "
            "else o_orderdate end",
        },
    ),
    "cdec_sites": Input(
        "customer",
        {
            "STA": f"'C' || {text('c_custkey')}",
            "Station Name": "c_name",
            "Latitude": latitude("c_custkey"),
            "Longitude": longitude("c_custkey"),
            "Sensors": "case when c_custkey % 9 = 0 then null else "
            f"{text('c_custkey % 25')} || ',' || {text('c_custkey * 7 % 40')} end",
        },
    ),
    "customer_points": Input(
        "customer",
        {
            "id": "c_custkey",
            "Latitude": latitude("c_custkey"),
            "Longitude": longitude("c_custkey"),
        },
    ),
    "supplier_points": Input(
        "supplier",
        {
            "id": "s_suppkey",
            "Latitude": shifted(SITE["Latitude"], "s_suppkey % 3"),
            "Longitude": SITE["Longitude"],
        },
    ),
}


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def derive(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input as a Spark plan."""
    source = INPUTS[name]
    columns = [
        F.expr(sql.replace("TIMESTAMP_TYPE", "timestamp_ntz")).alias(column)
        for column, sql in source.columns.items()
    ]
    return load(spark, folder, source.table).filter(source.where).select(*columns)


class Inputs(Mapping):
    """All inputs by name, each planned when it is asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder

    def __getitem__(self, name: str) -> DataFrame:
        return derive(self.spark, self.folder, name)

    def __iter__(self) -> Iterator[str]:
        return iter(INPUTS)

    def __len__(self) -> int:
        return len(INPUTS)


def derive_sql(name: str) -> str:
    """The same input as a query for the other side."""
    source = INPUTS[name]
    columns = ", ".join(
        f'{sql.replace("TIMESTAMP_TYPE", "timestamp")} AS "{column}"'
        for column, sql in source.columns.items()
    )
    return f"SELECT {columns} FROM {source.table} WHERE {source.where}"
