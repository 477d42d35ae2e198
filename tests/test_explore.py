from __future__ import annotations

import pytest

from fieldtally.plans import explore as ex
from fieldtally.plans.matrix import COLUMNS
from fieldtally.plans.surveys import PARAMETERS

SCHEMA = (
    "Year int, Station string, Station2 string, Source string, Latitude double, "
    "Longitude double, StationID string, N_years long, Benthic long, Phytoplankton long, "
    "Zooplankton long, Water_quality long, Fish long, Zoop_station string, "
    "Benthic_station array<string>, Max long, Extra_stations string"
)


def row(source, station, year, benthic=0, fish=0, n_years=1, zoop=None, names=None, extra=None):
    return (
        year, station, station, source, 38.0, -121.0, f"{source} {station or 'NA'}", n_years,
        benthic, 0, 0, 0, fish, zoop, names, max(benthic, fish), extra,
    )


@pytest.fixture(scope="module")
def sampling(frame):
    return frame(
        SCHEMA,
        row("EMP", "D4", 2018, fish=3, benthic=1, n_years=4, zoop="Z1", names=["D4-L", "D4-R"], extra="x"),
        row("EMP", "D4", 2019, fish=2, n_years=4, zoop="Z1", names=["D4-L", "D4-R"], extra="x"),
        row("EMP", "EZ2", 2018, fish=1),
        row("EMP", "EZ6", 2018, fish=1),
        row("EMP", None, 2018, fish=1),
        row("EDSM", "E1", 2018, fish=5),
        row("STN", "T", 2018, benthic=2),
    )


@pytest.fixture(scope="module")
def alias(sampling):
    return ex.station_alias(sampling)


def test_alias_names(alias, tuples):
    assert tuples(alias, "Source", "StationID", "Station") == sorted(
        [
            ("EDSM", "Unfixed EDSM stations", "Unfixed EDSM stations"),
            *[("EMP", f"EMP {s}", f"EMP {s}") for s in ("EZ2", "EZ6", "EZ2-SJR", "EZ6-SJR")],
            # One row for each of the two benthic names, as the names are opened first.
            ("EMP", "EMP D4", "EMP Z1"),
            ("EMP", "EMP D4", "EMP Z1"),
            ("EMP", "EMP D4", "EMP D4-L"),
            ("EMP", "EMP D4", "EMP D4-R"),
            ("EMP", "EMP D4", "EMP D4"),
            ("EMP", "EMP D4", "EMP D4"),
            ("EMP", "EMP NA", "EMP NA"),
            ("STN", "STN T", "STN T"),
        ],
        key=repr,
    )


def test_everything_by_year_is_the_table(sampling, alias, tuples):
    assert tuples(ex.explore(sampling, alias, by_year=True), *COLUMNS) == tuples(sampling, *COLUMNS)


def test_yearly_average(sampling, alias, tuples):
    found = ex.explore(sampling, alias, surveys=["EMP"], parameters=["Fish"])
    assert tuples(found, "Station", "Fish", "Benthic", "Max", "N_years") == sorted(
        [
            ("D4", 1.25, 0.25, 1.25, 4),
            ("EZ2", 1.0, 0.0, 1.0, 1),
            ("EZ6", 1.0, 0.0, 1.0, 1),
            (None, 1.0, 0.0, 1.0, 1),
        ],
        key=repr,
    )


def test_years_count_over_all_parameters(sampling, alias, tuples):
    found = ex.explore(sampling, alias, parameters=["Benthic"])
    assert tuples(found, "Station", "Benthic", "Fish") == [("D4", 0.25, 0.75), ("T", 2.0, 0.0)]


def test_fixed_sites_only(sampling, alias, tuples):
    found = ex.explore(sampling, alias, surveys=["EMP"], exclude_unfixed=True, by_year=True)
    assert tuples(found, "Station", "Year") == sorted(
        [("D4", 2018), ("D4", 2019), (None, 2018)], key=repr
    )


def test_selected_names(sampling, alias, tuples):
    every_unfixed = ["Unfixed EDSM stations", *ex.UNFIXED_ALIASES]
    found = ex.explore(sampling, alias, sites=["EMP D4-R", *every_unfixed], by_year=True)
    assert tuples(found, "Station", "Year") == [
        ("D4", 2018), ("D4", 2019), ("E1", 2018), ("EZ2", 2018), ("EZ6", 2018),
    ]
    without = [name for name in every_unfixed if name not in ("EMP EZ6", "Unfixed EDSM stations")]
    found = ex.explore(sampling, alias, sites=["EMP Z1", *without], by_year=True)
    assert tuples(found, "Station", "Year") == [("D4", 2018), ("D4", 2019), ("EZ2", 2018)]
    found = ex.explore(sampling, alias, sites=["EMP NA", *every_unfixed[1:]], by_year=True)
    assert tuples(found, "Station") == [("EZ2",), ("EZ6",), (None,)]


def test_effort_range_is_inclusive(sampling, alias, tuples):
    explored = ex.explore(sampling, alias, by_year=True)
    assert tuples(ex.effort_between(explored, "Fish", 2, 3), "Year", "Fish") == [(2018, 3), (2019, 2)]
    assert ex.effort_between(explored).count() == 7


def test_tooltips(sampling, alias):
    explored = ex.explore(sampling, alias)
    texts = {r.Station: r.tooltip for r in ex.plot_rows(explored).collect()}
    assert texts["E1"] == (
        "<table  border='1'><tr><td>Survey &nbsp</td><td>EDSM</td></tr>"
        "<tr><td>Station &nbsp</td><td>E1</td></tr>"
        "<tr><td>Alternate station names &nbsp</td><td>None</td></tr>"
        "<tr><td>N_Benthic &nbsp</td><td>0</td></tr><tr><td>N_Fish &nbsp</td><td>5</td></tr>"
        "<tr><td>N_Phytoplankton &nbsp</td><td>0</td></tr>"
        "<tr><td>N_Water_quality &nbsp</td><td>0</td></tr>"
        "<tr><td>N_Zooplankton &nbsp</td><td>0</td></tr><tr><td>N_Max &nbsp</td><td>5</td></tr>"
        "<tr><td>N_Years &nbsp</td><td>1</td></tr></table>"
    )
    assert "<td>1.25</td>" in texts["D4"] and "<td>x</td>" in texts["D4"]
    by_year = ex.plot_rows(ex.explore(sampling, alias, by_year=True), year=2019).collect()
    assert [r.Station for r in by_year] == ["D4"]
    assert by_year[0].tooltip.startswith(
        "<table  border='1'><tr><td>Year &nbsp</td><td>2019</td></tr>"
    )


def test_facets(spark, sampling, alias, tuples):
    names = ex.survey_names(spark)
    assert tuples(ex.surveys_with(sampling, names, ["Benthic"]), "Abbreviation") == [("EMP",), ("STN",)]
    assert tuples(ex.surveys_with(sampling, names), "Abbreviation") == [("EDSM",), ("EMP",), ("STN",)]
    assert tuples(ex.sites_of(alias, ["STN", "EDSM"])) == [("STN T",), ("Unfixed EDSM stations",)]
    fixed = {r.Station for r in ex.sites_of(alias, ["EMP"], exclude_unfixed=True).collect()}
    assert fixed == {"EMP D4", "EMP Z1", "EMP D4-L", "EMP D4-R", "EMP NA"}


def test_metrics_on_offer(sampling, tuples):
    others = [("Max", "Max N over all parameters"), ("N_years", "Number of years")]
    found = [(r.metric, r.label) for r in ex.metric_choices(sampling).orderBy("position").collect()]
    assert found == [("Benthic", "Benthic"), ("Fish", "Fish"), *others]
    found = [r.metric for r in ex.metric_choices(sampling, ["EDSM"]).orderBy("position").collect()]
    assert found == ["Fish", "Max", "N_years"]
    found = [r.metric for r in ex.metric_choices(sampling, ["none"]).orderBy("position").collect()]
    assert found == ["Max", "N_years"]
    empty = ex.metric_choices(sampling.limit(0)).orderBy("position").collect()
    assert [r.metric for r in empty] == [*PARAMETERS, "Max", "N_years"]
    assert empty[3].label == "Water quality"


def test_ranges(sampling, tuples):
    assert tuples(ex.metric_range(sampling, "Fish")) == [(0, 5)]
    assert tuples(ex.year_range(sampling)) == [(2018, 2019)]
    assert tuples(ex.bounding_box(sampling)) == [(-121.0, -121.0, 38.0, 38.0)]
    assert tuples(ex.survey_colours(sampling)) == [("EDSM",), ("EMP",), ("STN",)]


def test_scale(sampling):
    scaled = ex.scale_values(sampling, "Fish", log=True, low=1, filter_metric="Max")
    domain = ex.scale_domain(scaled, "Fish").first()
    assert (domain.min_scaled, round(domain.max_scaled, 6)) == (0.0, 1.791759)
    assert domain.title == "Fish effort</br>(samples per year)"
    assert [r.label for r in ex.scale_breaks(scaled, log=True).collect()] == [
        4.0, 3.0, 2.0, 2.0, 1.0, 1.0, 0.0, 0.0, 0.0
    ]  # every fifth of the logarithm up to log(6)
    plain = ex.scale_values(sampling, "N_years")
    assert [r.label for r in ex.scale_breaks(plain).collect()] == [4.0, 3.5, 3.0, 2.5, 2.0, 1.5, 1.0]
    assert ex.scale_domain(plain, "N_years").first().title == "N years"


def test_survey_info(frame, sampling):
    sheet = frame(
        "Survey string, Abbreviation string, Survey_link string, Data_source_name string, "
        "`Data source 1` string, `Data source 2` string",
        ("Environmental", "EMP", "http://e", "portal", "http://d", None),
        ("Restoration", "FRP", None, "portal", None, None),
    )
    found = ex.survey_info(sheet, sampling)
    assert found.columns[-2:] == ["Data source 1", "Data source 2"]
    rows = {r.Abbreviation: r for r in found.collect()}
    emp, frp = rows["EMP"], rows["FRP"]
    assert emp.Survey == "<a href='http://e'>Environmental</a>"
    assert (emp.Benthic, emp.Fish, emp["Water quality"]) == ("Yes", "Yes", "")
    assert (emp[ex.TOTAL_YEARS], emp[ex.MEAN_EFFORT]) == (4, 1.6)
    assert emp["Data source 1"] == "<a href='http://d'>portal</a>"
    assert emp["Data source 2"] == ""
    assert (frp.Survey, frp.Benthic, frp[ex.TOTAL_YEARS]) == ("Restoration", None, None)


@pytest.mark.parametrize("surveys, unfixed", [(None, False), (["EMP", "EDSM"], True), (["STN"], False)])
def test_facets_equal_the_single_queries(spark, sampling, tuples, surveys, unfixed):
    found = ex.facets(sampling, ["Fish"], surveys, unfixed).collect()

    def of(facet, *columns):
        return sorted(tuple(r[c] for c in columns) for r in found if r.facet == facet)

    assert of("survey", "label", "name") == tuples(ex.surveys_with(sampling, ex.survey_names(spark), ["Fish"]))
    sites = ex.sites_of(ex.station_alias(sampling), surveys, unfixed).distinct()
    assert of("site", "name") == sorted(tuples(sites))
    choices = ex.metric_choices(sampling, surveys).orderBy("position").collect()
    assert [m for _, m in of("metric", "rank", "name")] == [r.metric for r in choices]
    assert {m: t for m, t in of("metric", "name", "label")} == {r.metric: r.label for r in choices}
    assert of("effort", "low", "high") == tuples(ex.metric_range(ex.explore(sampling, None)))
    assert of("year", "low", "high") == tuples(ex.year_range(sampling))
    box = ex.bounding_box(sampling).first()
    assert of("longitude", "low", "high") == [(box.min_lon, box.max_lon)]
    assert of("latitude", "low", "high") == [(box.min_lat, box.max_lat)]


def test_facets_scan_once_and_do_without_rows(spark, sampling, tmp_path):
    sampling.write.parquet(str(tmp_path / "sampling"))
    stored = spark.read.parquet(str(tmp_path / "sampling"))
    plan = ex.facets(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    empty = ex.facets(sampling.limit(0)).collect()
    assert {(r.facet, r.name) for r in empty} == {("site", n) for n in [ex.UNFIXED_SURVEY_ALIAS, *ex.UNFIXED_ALIASES]}
