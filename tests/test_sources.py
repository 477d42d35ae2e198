from __future__ import annotations

from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldtally.operators.lookups import (
    drop_matching,
    full_directory,
    in_list,
    keep_matching,
    left_lookup,
    not_in_list,
)
from fieldtally.operators.reshape import complete_years, explode_names
from fieldtally.operators.tallies import stack
from fieldtally.plans import sensors
from fieldtally.plans.build import survey_tally
from fieldtally.plans.surveys import SURVEYS
from fieldtally.catalogue import queries
from fieldtally.sources import pages
from fieldtally.sources.pages import all_lines, html_tables, lines_of, page_tables, table_at
from fieldtally.sources.staging import stage
from fieldtally.sources.tables import (
    read_csv,
    read_sampling,
    read_table,
    survey_years,
    variables_between,
    write_sampling,
)


def test_typed_csv(spark, tmp_path, tuples):
    path = tmp_path / "sites.csv"
    path.write_text(
        "Other,Longitude_location,StationCode,Latitude_location\n"
        "x,-121.5, S1 ,38.1\nx,NA,NA,bad\nx,,\"\",38\n"
    )
    found = read_csv(spark, str(path), SURVEYS["djfmp"].sites)
    assert found.dtypes == [("Station", "string"), ("Latitude", "double"), ("Longitude", "double")]
    assert tuples(found) == sorted(
        [("S1", 38.1, -121.5), (None, None, None), (None, 38.0, None)], key=repr
    )
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Other" not in plan.split("ReadSchema")[1]


VISITS = {"Date": ("Date", "date"), "Station code": ("Station", "string"), "N": ("N", "int")}


def test_folder_of_files_with_headers_of_their_own(spark, tmp_path, tuples):
    folder = tmp_path / "visits, both"
    folder.mkdir()
    (folder / "a 2020.csv").write_text('Date,Station code,N\n2020-01-01,"S ""1"", x",3\n\n2020-01-02,,NA\n')
    (folder / "b 2021.csv").write_bytes(b"\xef\xbb\xbfN,\"Other, more\", Date ,Station code\r\n4,z,2021-05-06,S2\r\n5,z\r\n")
    (folder / "c+%20.csv").write_text("Station code,Date,N,More\nS3,bad,7,m,too many\n")
    (folder / "none.csv").write_text("")
    (folder / "header only.csv").write_text("N,Station code,Date\n")
    found = read_csv(spark, str(folder), VISITS)
    assert tuples(found.withColumn("Date", F.col("Date").cast("string")), "Date", "Station", "N") == sorted([
        ("2020-01-01", 'S "1", x', 3), ("2020-01-02", None, None), ("2021-05-06", "S2", 4),
        (None, None, 5), (None, "S3", 7),
    ], key=repr)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and plan.count(" csv") == 1  # the lines, and the headers written before


def test_equal_headers_need_no_join(spark, tmp_path, tuples):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(f"Station code,N,Date\n{name},1,2020-01-01\n")
    found = read_csv(spark, str(tmp_path), VISITS)
    assert tuples(found, "Station", "N") == [("a", 1), ("b", 1)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_large_files_are_split(spark, tmp_path):
    (tmp_path / "a.csv").write_text("N,Date,Station code\n" + "".join(f"{i},2020-01-01,s\n" for i in range(20_000)))
    (tmp_path / "b.csv").write_text("Station code,N,Date\n" + "".join(f"s,{i},2020-01-01\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        found = read_csv(spark, str(tmp_path), VISITS)
        assert found.rdd.getNumPartitions() > 10
        assert found.agg(F.count("Date"), F.sum("N"), F.count("Station")).first() == (40_000, 399_980_000, 40_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("\n")
    (tmp_path / "folder").mkdir()
    for path in (tmp_path, tmp_path / "folder"):
        found = read_csv(spark, str(path), VISITS)
        assert found.dtypes == [("Date", "date"), ("Station", "string"), ("N", "int")] and found.count() == 0


def test_a_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,N\n2020-01-01,1\n")
    with pytest.raises(ValueError, match="Station code"):
        read_csv(spark, str(tmp_path), VISITS)


def test_survey_from_files(spark, tmp_path, tuples):
    (tmp_path / "v.csv").write_text(
        "SampleTime,SampleDate,StationCode,Count\n9:05,1/5/2018,S1,3\n9:05,1/5/2018,S1,4\n"
    )
    (tmp_path / "s.csv").write_text(
        "StationCode,LatitudeLocation,LongitudeLocation\nS1,38,-121\nS1,38,-121\n"
    )
    survey = SURVEYS["ybfmp_fish"]
    inputs = {
        "ybfmp_fish": read_csv(spark, str(tmp_path / "v.csv"), survey.columns),
        "ybfmp_fish_sites": read_csv(spark, str(tmp_path / "s.csv"), survey.sites),
    }
    assert tuples(survey_tally("ybfmp_fish", inputs), "Station", "Year", "N") == [("S1", 2018, 1)]


def test_store_by_source(spark, tmp_path, frame, tuples):
    table = frame("Source string, Year int, N long", ("EMP", 2018, 3), ("2019", 2019, 4))
    path = str(tmp_path / "sampling")
    write_sampling(table, path)
    stored = read_sampling(spark, path)
    assert stored.dtypes == table.dtypes
    found = stored.filter(F.col("Source") == "EMP")
    assert tuples(found, "Source", "Year", "N") == [("EMP", 2018, 3)]
    assert "PartitionFilters: [isnotnull(Source" in found._jdf.queryExecution().executedPlan().toString()
    assert tuples(stored, "Source") == [("2019",), ("EMP",)]


def _files(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def test_refresh_of_one_source(spark, tmp_path, frame, tuples):
    kinds = "Source string, Year int, N long"
    path = str(tmp_path / "sampling")
    write_sampling(frame(kinds, ("EMP", 2018, 3), ("EMP", 2019, 5), ("STN", 2019, 4)), path)
    before = _files(tmp_path)
    write_sampling(frame(kinds, ("EMP", 2020, 9)).select("N", "Source", "Year"), path, refresh=True)
    after = _files(tmp_path)
    assert tuples(read_sampling(spark, path), "Source", "Year", "N") == [("EMP", 2020, 9), ("STN", 2019, 4)]
    kept = {p: t for p, t in before.items() if "Source=STN" in p}
    assert kept and kept.items() <= after.items()
    assert not any("Source=EMP" in p for p in before.keys() & after.keys())
    write_sampling(frame(kinds, ("20mm", 2001, 1)), path, refresh=True)
    assert tuples(read_sampling(spark, path), "Source") == [("20mm",), ("EMP",), ("STN",)]
    with pytest.raises(ValueError, match="differ"):
        write_sampling(frame("Source string, Year int, N double", ("EMP", 1, 1.0)), path, refresh=True)
    write_sampling(frame(kinds, ("EMP", 2018, 1)), path)
    assert tuples(read_sampling(spark, path), "Source", "N") == [("EMP", 1)]


def test_stage_keeps_rows(frame, tuples):
    table = frame("a int, b array<string>", (1, ["x"]), (2, None))
    assert tuples(stage(table, "t")) == tuples(table)


def test_years_and_sources(frame, tuples):
    table = frame("Source string, Year int", ("EMP", 2021), ("EMP", 2022), ("XX", 2000))
    found = survey_years(table, end_year=2021, sources=["EMP"])
    assert tuples(found) == [("EMP", 2021)]
    dated = frame(
        "Region string, Date timestamp_ntz",
        ("a", datetime(1949, 12, 31)), ("a", datetime(1950, 1, 1)),
        ("b", datetime(2021, 12, 31, 23)), ("b", datetime(2022, 1, 1)),
    )
    found = variables_between({"v": dated, "w": dated}, 1950, 2021, starts={"w": 2000})
    assert (found["v"].count(), found["w"].count()) == (2, 1)
    assert variables_between({"v": dated}, 1950, 2021, ["a"])["v"].count() == 1


def test_missing_keys_match(frame, tuples):
    left = frame("k string, n int", ("a", 1), (None, 2), ("c", 3))
    right = frame("k string, v string", ("a", "x"), ("a", "y"), (None, "z"))
    assert tuples(left_lookup(left, right, ["k"]), "n", "v") == [(1, "x"), (1, "y"), (2, "z"), (3, None)]
    assert tuples(keep_matching(left, right, ["k"]), "n") == [(1,), (2,)]
    assert tuples(drop_matching(left, right, ["k"]), "n") == [(3,)]
    other = frame("k string, v string", ("d", "x"), (None, "z"))
    assert tuples(full_directory(left, other, "k"), "k", "n", "v") == sorted(
        [("a", 1, None), (None, 2, "z"), ("c", 3, None), ("d", None, "x")], key=repr
    )


def test_lookup_joins_a_table_with_itself(frame, tuples):
    table = frame("k string, n int", ("a", 1), ("b", 2))
    right = table.select("k", (F.col("n") * 10).alias("m"))
    assert tuples(left_lookup(table, right, ["k"]), "k", "n", "m") == [("a", 1, 10), ("b", 2, 20)]


def test_membership_of_missing_values(frame, tuples):
    table = frame("k string", ("a",), (None,), ("b",))
    assert tuples(table.filter(in_list("k", ["a"]))) == [("a",)]
    assert tuples(table.filter(not_in_list("k", ["a"]))) == sorted([("b",), (None,)], key=repr)
    assert table.filter(not_in_list("k", [])).count() == 3


def test_stack_by_name(frame, tuples):
    found = stack(frame("a int, b int", (1, 2)), frame("b int, c int", (3, 4)))
    assert tuples(found, "a", "b", "c") == [(1, 2, None), (None, 3, 4)]


def test_complete_years(frame, tuples):
    table = frame(
        "k string, s int, e int",
        ("a", 2001, 2003), ("a", 2006, 2006), ("b", 2001, 2001), ("b", 2001, 2002), (None, 2000, 2000),
    )
    assert tuples(complete_years(table, ["k"], "s", "e")) == sorted(
        [*[("a", y) for y in range(2001, 2007)], ("b", 2001), ("b", 2001), ("b", 2002), (None, 2000)],
        key=repr,
    )


def test_explode_keeps_rows_without_names(frame, tuples):
    table = frame("k int, v array<string>", (1, ["x", "y"]), (2, None), (3, []))
    assert tuples(explode_names(table, "v")) == sorted(
        [(1, "x"), (1, "y"), (2, None), (3, None)], key=repr
    )


SQUARE = [(1, 0.0, 4e6, 0.0, 5e6), (1, 0.0, 5e6, 1e6, 5e6), (1, 1e6, 5e6, 1e6, 4e6), (1, 1e6, 4e6, 0.0, 4e6)]
EDGES = "poly_id int, x1 double, y1 double, x2 double, y2 double"


def test_sensor_years(frame, tuples):
    sheet = frame(
        "station_name string, station_id string, latitude double, longitude double, "
        "sensname string, start_date timestamp_ntz, end_date timestamp_ntz",
        ("Antioch", "ANC", 38.0, -121.8, "flow", datetime(2001, 5, 1), datetime(2003, 1, 1)),
        ("Antioch", "ANC", 38.0, -121.8, "flow", datetime(2005, 5, 1), None),
        ("Far", "F", 60.0, -121.8, "flow", datetime(2001, 5, 1), datetime(2003, 1, 1)),
    )
    found = sensors.sensor_years(sheet, frame(EDGES, *SQUARE), as_of_year=2006)
    assert found.columns == ["Station", "Latitude", "Longitude", "Year", "Sensor"]
    assert tuples(found, "Station", "Year") == [("Antioch (ANC)", y) for y in range(2001, 2007)]


def test_station_sensors(frame, tuples):
    sites = frame(
        "STA string, `Station Name` string, Latitude double, Longitude double, Sensors string",
        ("ANC", "Antioch", 38.0, -121.8, "1,20"), ("B", "Bay", 38.0, -121.8, None),
        ("F", "Far", 60.0, -121.8, "1"),
    )
    page = (
        "<table><tr><th colspan='3'>Sensors</th></tr>"
        "<tr><td>Sensor Num</td><td>Name</td><td>Description</td></tr>"
        "<tr><td>1</td><td>s</td><td>RIVER STAGE</td></tr></table>"
    )
    listed = sensors.sensor_list(frame("page int, html string", (1, page)), "page", "html")
    assert tuples(listed) == [("1", "RIVER STAGE")]
    found = sensors.station_sensors(sites, frame(EDGES, *SQUARE), listed)
    assert tuples(found, "Station", "Sensors", "description") == [
        ("Antioch (ANC)", "1", "RIVER STAGE"), ("Antioch (ANC)", "20", None), ("Bay (B)", None, None),
    ]


SIX = "<tr>" + "<td>{0}</td>" * 6 + "</tr>"
HEAD = "<tr>" + "<th>h</th>" * 6 + "</tr>"


def test_metadata_needs_exactly_one_wide_table(frame, tuples):
    one = f"<table>{HEAD}{SIX.format('a')}</table><table><tr><td>b</td></tr></table>"
    two = one + f"<table>{SIX.format('c')}</table>"
    plain = f"<table>{SIX.format('d')}</table>"
    pages = frame(
        "Station string, html string",
        ("one", one), ("two", two), ("plain", plain), ("none", "<p>x</p>"), ("null", None),
    )
    found = sensors.station_metadata(pages)
    assert found.columns == ["Station", *sensors.METADATA_COLUMNS]
    assert tuples(found, "Station", "Plot") == [("one", "a"), ("plain", "d")]


def test_table_at_a_fixed_place(frame, tuples):
    page = (
        "<body><table><tr><td>0</td></tr></table><div id=main_content><p>t<div><div>"
        "<table><tr><td>1</td></tr></table><table><tr><td>2</td><td>x</td></tr></table>"
        "</div><div><table></table><table><tr><td>3</td></tr></table></div></div></div>"
    )
    tables = html_tables(frame("k int, html string", (1, page), (2, "<table></table>")), "k", "html")
    found = lines_of(tables, "k", table_at("main_content/div/div[1]", 2))
    assert [(r.k, r.row_no, r.cells) for r in found.collect()] == [(1, 1, ["2", "x"])]
    assert [r.cells for r in all_lines(tables, "k").orderBy("table_no").collect()] == [
        ["0"], ["1"], ["2", "x"], ["3"],
    ]


@pytest.mark.parametrize(
    ("html", "lines"),
    [
        ("<table><tr><td>1<td>2<tr><td>3</table>", [["1", "2"], ["3"]]),
        ("<TABLE><TR><TD>a &amp; b</TD></TR></TABLE>", [["a & b"]]),
        ("<table><!-- <tr><td>no</td></tr> --><tr><td>1<br>2</td></tr></table>", [["1\n2"]]),
        ("<table><tr><td colspan=2>w</td><td>x</td></tr></table>", [["w", "w", "x"]]),
        (
            "<table><tr><td rowspan='2'>d</td><td>1</td></tr><tr><td>2</td></tr></table>",
            [["d", "1"], ["d", "2"]],
        ),
        ("<table><tr><td title='a>b'>1</td></tr></table>", [["1"]]),
        ("<table><tr><td>1<script>if (a<b) '<td>'</script></td></tr></table>", [["1"]]),
        ("<table><tr><td><p>a<p>b</td></tr></table>", [["ab"]]),
    ],
)
def test_markup(html, lines):
    assert [line["cells"] for line in page_tables(html)[0]["lines"]] == lines


def test_nested_tables_keep_their_own_cells():
    outer, inner = page_tables(
        "<table><tr><td>a<table><tr><td>b</td></tr></table>c</td><td>d</td></tr></table>"
    )
    assert [line["cells"] for line in outer["lines"]] == [["ac", "d"]]
    assert [line["cells"] for line in inner["lines"]] == [["b"]]


def test_long_tables_go_back_few_pages_at_a_time():
    texts = [f"<table>{'<tr><td>x</td><td>y</td></tr>' * 1000}</table>", "", None] * 40
    portions = list(pages._portions(pa.array(texts, pa.string()), 10))
    cells = [sum(t["width"] * len(t["lines"]) for page in p.to_pylist() for t in page) for p in portions]
    assert len(portions) > 2 and max(cells) < pages.OUTPUT_CELLS + 2000
    assert [len(page) for p in portions for page in p.to_pylist()] == [1, 0, 0] * 40


def test_wide_pages_are_made_after_suppliers_are_dealt_out(spark, tmp_path, frame):
    suppliers = [(k, f"s{k}") for k in range(2 * queries.WIDE_PAGES + 1)]
    frame("s_suppkey long, s_name string", *suppliers).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    found = queries.QUERIES["wide_spans"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = plan.split("RoundRobinPartitioning(")[1]
    assert int(dealt.split(")")[0]) == max(3, spark.sparkContext.defaultParallelism)
    assert "concat(" not in dealt.split("Scan parquet")[0] and "concat(" in plan
    assert found.filter("width = 2 AND n_lines = 1500 AND least_cell = concat('s', s_suppkey)").count() == len(suppliers)
