from __future__ import annotations

from datetime import datetime

from fieldtally.__main__ import build
from fieldtally.plans.landed import Landed
from fieldtally.sources.tables import read_sampling

CSV = {
    "ybfmp_zoop": "Date,Time,StationCode\n2018-01-05,10:00:00,S1\n2018-01-05,10:00:00,S1\n",
    "ybfmp_zoop_sites": "StationCode,Latitude,Longitude\nS1,38.5,-121.5\n",
    "edsm_20mm": "Date,Time,TargetLat,TargetLong,Station\n2018-01-05,10:00:00,38,-121,E1\n",
    "edsm_kdtr": "Station,Date,Time,TargetLat,TargetLong\nE1,2018-01-06,NA,38.2,-121\n",
    "djfmp_seine": "StationCode,SampleDate,SampleTime\nJ,2018-01-05,10:00:05\nJ,2018-01-05,10:00:40\n",
    "djfmp_sites": "StationCode,Latitude_location,Longitude_location\nJ,38.1,-121.1\n",
    "ybfmp_fish": "SampleDate,SampleTime,StationCode\n1/5/2018,9:05,S1\n1/6/2018,9:05,S1\n",
    "ybfmp_fish_sites": "StationCode,LatitudeLocation,LongitudeLocation\nS1,38.5,-121.5\n",
    "sls_fish": "Date,Time,Station\n2018-01-05,10:00:00,912\n",
    "sls_sites": "Station,Lat,Long\n901,37 30 36,121 30 0\n",
    "sensor_sheet": "station_name,station_id,sensname,latitude,longitude,start_date,end_date\n"
    "Antioch,ANC,flow,38.0,-121.8,2001-05-01,2002-05-01\n",
    "cdec_sites": "STA,Station Name,Latitude,Longitude,Sensors\nANC,Antioch,38.0,-121.8,\"1,20\"\n",
    "survey_sheet": "Survey,Abbreviation,Survey_link,Data_source_name,Data source 1,Data source 2\n"
    "Environmental,EMP,http://e,portal,http://d,NA\n",
}


def test_landing_folder_to_results(spark, frame, tmp_path, tuples):
    landing, results = tmp_path / "landing", tmp_path / "results"
    landing.mkdir()
    for name, text in CSV.items():
        (landing / f"{name}.csv").write_text(text)
    day, moment = datetime(2018, 1, 5), datetime(2018, 1, 5, 9)
    place = "Latitude double, Longitude double"
    sample = "Station string, Source string, Date timestamp_ntz"
    html = "<table><tr><th>Sensors</th></tr><tr><td>Sensor Num</td><td>Description</td></tr>" + (
        "<tr><td>1</td><td>STAGE</td></tr></table>"
    )
    tables = {
        "zoop_env": frame(
            f"{sample}, {place}", ("Z1", "EMP", day, 38.0, -121.0), ("Z9", "EMP", day, 37.0, -121.0)
        ),
        "zoop_sites": frame(
            f"Source string, Station string, {place}",
            ("EMP", "Z1", 38.001, -121.0), ("EMP", "Z9", 37.0, -121.0),
        ),
        "water_quality": frame(
            f"Source string, Station string, Year int, Date timestamp_ntz, "
            f"Datetime timestamp_ntz, {place}",
            ("EMP", "D4", 2018, day, moment, 38.0, -121.0),
            ("USGS", "3", 2018, day, moment, 38.3, -121.3),
            ("EMP", "D4", 2022, day, moment, 38.0, -121.0),
        ),
        "bivalves": frame(sample, ("D4-L", "EMP", day), ("D4-R", "EMP", day)),
        "phytoplankton": frame(sample, ("D4", "EMP", day), ("D99", "EMP", day)),
        "subregions": frame(
            "poly_id int, ring_id int, seq int, x double, y double",
            (1, 0, 0, 0.0, 4e6), (1, 0, 1, 1e6, 4e6), (1, 0, 2, 1e6, 5e6), (1, 0, 3, 0.0, 5e6),
        ),
        "sensor_page": frame("page int, html string", (1, html)),
        "site_pages": frame(
            "Station string, html string",
            ("ANC", "<table><tr>" + "<td>c</td>" * 6 + "</tr></table>"),
        ),
    }
    for name, table in tables.items():
        table.write.parquet(str(landing / f"{name}.parquet"))
    assert set(Landed(spark, str(landing))) == {*CSV, *tables}

    build(spark, str(landing), str(results), 2020)

    sampling = read_sampling(spark, str(results / "sampling"))
    columns = (
        "StationID", "Station", "Benthic", "Phytoplankton", "Zooplankton", "Water_quality", "Fish",
    )
    assert tuples(sampling, *columns) == [
        ("DJFMP J", "J", 0, 0, 0, 1, 1),
        ("EDSM E1", "E1", 0, 0, 0, 2, 2),
        ("EMP D4", "D4", 2, 1, 1, 1, 0),
        ("EMP Z9", "Z9", 0, 0, 1, 0, 0),
        ("SFBS 3", "3", 0, 0, 0, 1, 0),
        ("SLS 912", "912", 0, 0, 0, 1, 1),
        ("YBFMP S1", "S1", 0, 0, 1, 3, 2),
    ]
    labels = {r.Station: r.Extra_stations for r in sampling.collect()}
    assert labels["D4"] == "Benthic: D4-L, D4-R | Zooplankton: Z1"
    read = lambda name: spark.read.parquet(str(results / name))
    assert read("station_alias").count() == 16
    assert read("survey_info").first()["Data source 2"] == ""
    assert tuples(read("sensor_years"), "Station", "Year") == [
        ("Antioch (ANC)", 2001), ("Antioch (ANC)", 2002),
    ]
    assert tuples(read("station_sensors"), "Sensors", "description") == [("1", "STAGE"), ("20", None)]
    assert read("station_metadata").count() == 1
