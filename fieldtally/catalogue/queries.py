"""The registered queries. Each takes a session and the folder of the test tables
and returns a plan over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.catalogue.inputs import (
    PRIORITY_PARAMETER,
    SEGMENT_SOURCE,
    Inputs,
    derive,
    load,
)
from fieldtally.functions.numbers import strict_avg
from fieldtally.functions.projection import planar_distance, with_utm
from fieldtally.functions.text import paste_na, readable, split_part
from fieldtally.functions.times import parse_date, parse_datetime, to_minute
from fieldtally.operators.lookups import drop_matching, left_lookup, not_in_list
from fieldtally.operators.reshape import complete_years, names_to_rows
from fieldtally.operators.polygons import inside, ring_edges
from fieldtally.operators.spatial import nearest
from fieldtally.operators.spatial import nearest_region as to_nearest_region
from fieldtally.operators.tallies import collect_names, count_at_each_place, count_rows, stack
from fieldtally.plans import explore as ex
from fieldtally.plans import matrix, names, sensors, surveys
from fieldtally.plans.build import sampling_table, survey_tally
from fieldtally.plans.surveys import PARAMETERS, SURVEYS
from fieldtally.sources.pages import all_lines, cell, html_tables
from fieldtally.sources.staging import run_folder, stage
from fieldtally.sources.tables import (
    read_csv,
    read_sampling,
    read_table,
    rows,
    survey_years,
    variables_between,
    write_sampling,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Arguments of the exploring queries.
SOME_SURVEYS = ["EMP", "FMWT", "EDSM"]
SOME_PARAMETERS = ["Fish", "Water_quality"]
SOME_YEAR = 1998
# Corners of the plots, as parts of their size.
PLOT_CORNERS = [(1.0, 0.0), (0.25, 0.25), (0.0, 1.0), (-1.0, 0.5), (-0.5, -1.0)]
# Pages of many lines that one task reads.
WIDE_PAGES = 250
STATION_NAMES = ["EMP EZ2", "EMP EZ6-SJR", "EMP C25-PROMO", "FMWT C7", "20mm Zoo 30"]


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(table: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return table.withColumns({c: F.round(c, digits) for c in columns})


def placed(table: DataFrame) -> DataFrame:
    return rounded(table, "Latitude", "Longitude")


def flat(table: DataFrame) -> DataFrame:
    """Array columns as text, so that results compare."""
    return placed(table).withColumn("Benthic_station", F.array_join("Benthic_station", ", "))


# --- surveys -----------------------------------------------------------------


def tally(name: str) -> Query:
    return lambda spark, folder: placed(survey_tally(name, Inputs(spark, folder)))


QUERIES["survey_site_lookup"] = tally("ybfmp_zoop")
QUERIES["survey_own_places"] = tally("edsm")
QUERIES["survey_whole_minutes"] = tally("djfmp")
QUERIES["survey_month_first"] = tally("ybfmp_fish")
QUERIES["survey_larval"] = tally("sls")


@query
def merge_two(spark, folder):
    inputs = Inputs(spark, folder)
    tallies = [survey_tally(name, inputs) for name in ("ybfmp_fish", "ybfmp_zoop")]
    return placed(surveys.merge_datasets(*tallies))


@query
def zooplankton(spark, folder):
    inputs = Inputs(spark, folder)
    tally = survey_tally("ybfmp_zoop", inputs)
    return placed(surveys.zooplankton(inputs["zoop_env"], tally))


def quality_tally(spark: SparkSession, folder: str) -> DataFrame:
    samples = survey_years(
        derive(spark, folder, "water_quality"),
        end_year=surveys.LAST_YEAR,
        sources=surveys.WATER_QUALITY_SOURCES,
    )
    return surveys.water_quality(samples)


@query
def moving_sites(spark, folder):
    return placed(quality_tally(spark, folder))


@query
def fish(spark, folder):
    caught = survey_tally("ybfmp_fish", Inputs(spark, folder))
    return placed(surveys.fish(quality_tally(spark, folder), caught))


@query
def replicate_fold(spark, folder):
    samples = derive(spark, folder, "bivalves")
    return placed(surveys.benthic(samples, stage(quality_tally(spark, folder), "quality")))


@query
def name_folding(spark, folder):
    samples = derive(spark, folder, "phytoplankton")
    return placed(surveys.phytoplankton(samples, stage(quality_tally(spark, folder), "quality")))


@query
def parsed_moments(spark, folder):
    """Tolerant parsing: how many visits fall on each date, hour and minute, and
    how many have no valid date or time."""
    raw = derive(spark, folder, "djfmp_seine")
    moment = to_minute(parse_datetime(F.col("Date"), F.col("Time")))
    return raw.select(parse_date(F.col("Date")).alias("Date"), moment.alias("moment")).groupBy(
        F.year("Date").alias("Year"), F.month("Date").alias("Month"), F.hour("moment").alias("hour"), F.minute("moment").alias("minute")
    ).agg(F.count("*").alias("N"))


@query
def dms_to_decimal(spark, folder):
    return rounded(surveys.larval_sites(derive(spark, folder, "sls_sites")), "Latitude", "Longitude")


@query
def variables_in_years(spark, folder):
    """Two variables of a multi-table source, each from its own first year."""
    found = variables_between(
        {name: derive(spark, folder, name) for name in ("bivalves", "phytoplankton")},
        1996,
        1999,
        starts={"phytoplankton": 1998},
    )
    counted = [
        count_rows(table.withColumn("Year", F.year("Date")), ["Year", "Source"]).withColumn(
            "variable", F.lit(name)
        )
        for name, table in found.items()
    ]
    return stack(*counted)


# --- names and places --------------------------------------------------------


@query
def utm_project(spark, folder):
    return rounded(with_utm(derive(spark, folder, "customer_points")), "x", "y", digits=3)


@query
def nearest_match(spark, folder):
    quality = stage(quality_tally(spark, folder), "quality")
    matches = names.match_sites(derive(spark, folder, "zoop_sites"), quality)
    return rounded(rounded(matches, "WQ_lat", "WQ_lon"), "Distance", digits=3)


def _points(spark, folder, name):
    return with_utm(derive(spark, folder, name))


@query
def nearest_any_distance(spark, folder):
    found = nearest(
        _points(spark, folder, "customer_points"), _points(spark, folder, "supplier_points"), "id"
    )
    return found.select("id", "nearest_id", F.round("distance", 3).alias("distance"))


@query
def nearest_in_radius(spark, folder):
    found = nearest(
        _points(spark, folder, "customer_points"),
        _points(spark, folder, "supplier_points"),
        "id",
        max_distance=4000.0,
    )
    return found.select("id", "nearest_id", F.round("distance", 3).alias("distance"))


@query
def paired_distance(spark, folder):
    """Row by row distance of two joined point columns."""
    left = _points(spark, folder, "customer_points")
    right = _points(spark, folder, "supplier_points").withColumnsRenamed({"x": "x2", "y": "y2"})
    pairs = left.join(right.select("id", "x2", "y2"), "id")
    distance = planar_distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    return pairs.select("id", F.round(distance, 3).alias("distance"))


@query
def harmonised_names(spark, folder):
    tallies = surveys.zooplankton(derive(spark, folder, "zoop_env"))
    quality = stage(quality_tally(spark, folder), "quality")
    matches = names.match_sites(derive(spark, folder, "zoop_sites"), quality)
    return placed(names.harmonise(tallies, matches))


@query
def alias_directory(spark, folder):
    quality = stage(quality_tally(spark, folder), "quality")
    matches = stage(names.match_sites(derive(spark, folder, "zoop_sites"), quality), "matches")
    directory = names.alias_directory(matches, derive(spark, folder, "bivalves"))
    return directory.withColumn("Benthic_station", F.array_join("Benthic_station", ", "))


def regions(spark: SparkSession, folder: str) -> DataFrame:
    """A diamond around a place of each nation, as polygon edges."""
    centre_x = F.lit(550000.0) + F.col("n_nationkey") * F.lit(4500.0)
    centre_y = F.lit(4160000.0) + F.col("n_nationkey") * 7 % 25 * F.lit(4000.0)
    size = F.lit(9000.0)
    corners = [
        (centre_x + size, centre_y),
        (centre_x, centre_y + size),
        (centre_x - size, centre_y),
        (centre_x, centre_y - size),
    ]
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in corners])
    points = load(spark, folder, "nation").select(
        F.col("n_nationkey").alias("poly_id"),
        F.lit(0).alias("ring_id"),
        F.posexplode(ring).alias("seq", "corner"),
    )
    return ring_edges(points.select("poly_id", "ring_id", "seq", "corner.x", "corner.y"))


@query
def inside_region(spark, folder):
    points = derive(spark, folder, "customer_points")
    return sensors.in_region(points, regions(spark, folder)).select("id")


def ring_of(table: DataFrame, key: str, centre: tuple[Column, Column], corners: list) -> DataFrame:
    """Edges of one polygon for each row of a table, its corners as offsets from a centre."""
    ring = F.array(*[
        F.struct((centre[0] + dx).alias("x"), (centre[1] + dy).alias("y")) for dx, dy in corners
    ])
    points = table.select(
        F.col(key).alias("poly_id"), F.lit(0).alias("ring_id"), F.posexplode(ring).alias("seq", "corner")
    )
    return ring_edges(points.select("poly_id", "ring_id", "seq", "corner.x", "corner.y"))


def plots(spark: SparkSession, folder: str) -> DataFrame:
    """A dented polygon for each order, most some hundred metres wide, some ten times
    as wide."""
    key = F.col("o_orderkey")
    centre = (
        F.lit(500000.0) + (key * 7919 % 150000).cast("double"),
        F.lit(4150000.0) + (key * 104729 % 115000).cast("double"),
    )
    size = (F.lit(100.0) + key % 11 * F.lit(40.0)) * F.when(key % 50 == 1, 10.0).otherwise(1.0)
    corners = [(size * dx, size * dy) for dx, dy in PLOT_CORNERS]
    return ring_of(load(spark, folder, "orders"), "o_orderkey", centre, corners)


@query
def inside_many_regions(spark, folder):
    points = derive(spark, folder, "customer_points")
    return inside(with_utm(points), plots(spark, folder)).select("id")


@query
def nearest_region(spark, folder):
    """Places to the nearest of the suppliers' polygons, as visits to station areas."""
    key = F.col("s_suppkey")
    centre = (
        F.lit(500000.0) + (key * 7919 % 150000).cast("double"),
        F.lit(4150000.0) + (key * 104729 % 115000).cast("double"),
    )
    corners = [(F.lit(2000.0 * dx), F.lit(2000.0 * dy)) for dx, dy in PLOT_CORNERS]
    edges = ring_of(load(spark, folder, "supplier"), "s_suppkey", centre, corners)
    found = to_nearest_region(with_utm(derive(spark, folder, "customer_points")), edges)
    return found.select("id", "nearest_id", F.round("distance", 3).alias("distance"))


# --- effort table ------------------------------------------------------------


def visits_by_parameter(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as visits of their customer's station: one tally per parameter."""
    station = (
        "case when c_mktsegment = 'AUTOMOBILE' then case c_custkey % 40 when 0 then 'NZEZ2' "
        "when 1 then 'NZEZ6' when 2 then 'NZEZ2SJR' when 3 then 'NZEZ6SJR' "
        "else 'C' || cast(c_custkey as string) end else 'C' || cast(c_custkey as string) end"
    )
    customers = load(spark, folder, "customer").select(
        "c_custkey",
        F.expr(SEGMENT_SOURCE).alias("Source"),
        F.expr(station).alias("Station"),
    )
    orders = (
        load(spark, folder, "orders")
        .select(
            F.col("o_custkey").alias("c_custkey"),
            F.year("o_orderdate").alias("Year"),
            F.expr(PRIORITY_PARAMETER).alias("Parameter"),
            "o_orderdate",
        )
        .distinct()
    )
    counted = count_rows(orders, ["c_custkey", "Year", "Parameter"])
    latitude = F.lit(37.5) + F.length("Station") * F.lit(0.125)
    tallies = counted.join(customers, "c_custkey").groupBy(
        "Source", "Station", "Year", "Parameter"
    ).agg(F.sum("N").alias("N"))
    return tallies.select(
        "*",
        F.col("Station").alias("Station2"),
        latitude.alias("Latitude"),
        (F.lit(-122.0) + F.length("Source") * F.lit(0.25)).alias("Longitude"),
    )


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """Other names of some sites, from parts and suppliers. Some parts have no benthic
    name, some have two."""
    part = F.col("p_partkey") % 5
    name = paste_na(paste_na(F.lit("C"), "p_partkey", sep=""), "p_type", sep="-")
    benthic = load(spark, folder, "part").select(
        paste_na(F.lit("C"), "p_partkey", sep="").alias("Station"),
        F.when(part < 3, name).alias("Benthic_station"),
        part.alias("part"),
    )
    more = benthic.filter(F.col("part") == 0).withColumn(
        "Benthic_station", paste_na("Benthic_station", F.lit("x"), sep="-")
    )
    arrays = collect_names(stack(benthic, more), "Station", "Benthic_station")
    arrays = arrays.withColumn(
        "Benthic_station", F.when(F.size("Benthic_station") > 0, F.col("Benthic_station"))
    )
    zooplankton = load(spark, folder, "supplier").select(
        paste_na(F.lit("C"), F.col("s_suppkey") * 3, sep="").alias("Station"),
        paste_na(F.lit("Zoo"), F.col("s_suppkey") * 3).alias("Zoop_station"),
    )
    return names.full_directory(zooplankton, arrays, "Station")


def sampling(spark: SparkSession, folder: str) -> DataFrame:
    merged = matrix.merge_tallies(visits_by_parameter(spark, folder))
    return matrix.effort_matrix(merged, directory(spark, folder))


@query
def effort_matrix(spark, folder):
    return flat(sampling(spark, folder))


@query
def sampling_build(spark, folder):
    """The whole batch over every derived input. The stand-in sites meet in
    one cell now and then, hence the sum."""
    return flat(sampling_table(Inputs(spark, folder), on_duplicate="sum"))


@query
def union_recode(spark, folder):
    tallies = surveys.zooplankton(derive(spark, folder, "zoop_env"))
    return placed(matrix.merge_tallies(tallies, quality_tally(spark, folder)))


@query
def mean_site(spark, folder):
    """Mean place per group, unknown as soon as one place is unknown."""
    points = load(spark, folder, "customer").select(
        "c_nationkey",
        "c_mktsegment",
        F.when(F.col("c_custkey") % 97 != 0, F.col("c_acctbal")).alias("value"),
    )
    return rounded(
        points.groupBy("c_nationkey", "c_mktsegment").agg(strict_avg(F.col("value")).alias("mean")),
        "mean",
        digits=4,
    )


@query
def extra_label(spark, folder):
    return directory(spark, folder).select("Station", matrix.extra_label().alias("Extra_stations"))


def merged_tallies(spark, folder):
    return matrix.merge_tallies(
        surveys.zooplankton(derive(spark, folder, "zoop_env")),
        count_at_each_place(
            surveys.with_coordinates(derive(spark, folder, "water_quality")).select(
                "Year", "Station", F.col("Station").alias("Station2"), "Source", "Latitude", "Longitude"
            ),
            surveys.LABELLED,
        ),
    )


@query
def conflict_report(spark, folder):
    return placed(matrix.conflict_report(merged_tallies(spark, folder)))


@query
def conflicting_places(spark, folder):
    return placed(matrix.conflicting_places(merged_tallies(spark, folder)))


# --- sensors and pages -------------------------------------------------------


@query
def filled_years(spark, folder):
    """Some orders have no start, some end before they start."""
    key, year = F.col("o_orderkey"), F.year("o_orderdate")
    spans = load(spark, folder, "orders").select(
        "o_custkey",
        F.when(key % 7 > 0, year).alias("start_year"),
        (year + (key % 5 - 2).cast("int")).alias("end_year"),
    )
    return complete_years(spans, ["o_custkey"], "start_year", "end_year")


@query
def sensor_years(spark, folder):
    sheet = derive(spark, folder, "sensor_sheet")
    return placed(sensors.sensor_years(sheet, regions(spark, folder), as_of_year=2003))


def sensor_page(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as HTML sensor lists, one page each."""
    cells = [
        F.col("s_suppkey").cast("string"), F.col("s_name"), F.col("s_nationkey").cast("string"),
        F.lit("a"), F.lit("b"), F.lit("unused"),
    ]
    return load(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("page"),
        F.concat(
            F.lit("<html><body><p>List<table><tr><th colspan=6>Sensors</th></tr><tr>"),
            *[F.lit(f"<td>{t}</td>") for t in ("Sensor Num", "Description", "C", "D", "E", "F")],
            F.lit("</tr>"),
            html_row(cells),
            F.lit("</table><table><tr><td>other</td></tr></table>"),
        ).alias("html"),
    )


def html_row(cells: list[Column], tag: str = "td") -> Column:
    parts = [F.concat(F.lit(f"<{tag}> "), c, F.lit(f"</{tag}>")) for c in cells]
    return F.concat(F.lit("<tr>"), *parts, F.lit("</tr>"))


@query
def sensor_list(spark, folder):
    return sensors.sensor_list(sensor_page(spark, folder).repartition(_cores(spark)), "page", "html")


@query
def station_sensors(spark, folder):
    return placed(
        sensors.station_sensors(
            derive(spark, folder, "cdec_sites"),
            regions(spark, folder),
            sensors.sensor_list(sensor_page(spark, folder).repartition(_cores(spark)), "page", "html"),
        )
    )


def site_pages(spark: SparkSession, folder: str) -> DataFrame:
    """A page for every part: a narrow table, then none, one or two tables of six
    columns, with or without a header row."""
    key = F.col("p_partkey")
    cells = [
        F.col("p_name"), key.cast("string"), F.col("p_brand"), F.col("p_type"),
        F.col("p_size").cast("string"), F.lit("a &amp; b"),
    ]
    header = F.when(key % 2 == 0, html_row([F.lit(c) for c in sensors.METADATA_COLUMNS], "th"))
    six = F.concat(
        F.lit("<table border=1><tbody>"),
        F.coalesce(header, F.lit("")),
        html_row(cells),
        html_row([F.lit("x") for _ in cells]),
        F.lit("</tbody></table>"),
    )
    repeated = F.when(key % 10 == 3, F.concat(six, six)).when(key % 10 == 4, F.lit("")).otherwise(six)
    return load(spark, folder, "part").select(
        F.concat(F.lit("P"), key.cast("string")).alias("Station"),
        F.concat(
            F.lit("<!DOCTYPE html><div id='main_content'><div><div><table><tr><td>1<td>2</table>"),
            repeated,
            F.lit("</div><div>end<br></div></div></div>"),
        ).alias("html"),
    )


@query
def station_pages(spark, folder):
    return sensors.station_metadata(site_pages(spark, folder).repartition(_cores(spark)))


@query
def station_tables(spark, folder):
    return sensors.station_tables(site_pages(spark, folder).repartition(_cores(spark))).select(
        "Station", "row_no", F.array_join("cells", "|").alias("cells")
    )


@query
def landed_lists(spark, folder):
    """List items of every landed page, once its lists are marked up as tables."""
    marked = load(spark, folder, "pages").select(
        "page_id",
        F.regexp_replace(
            F.regexp_replace("html", "<(/?)ul>", "<$1table>"), "<(/?)li>", "<$1tr>"
        ).alias("html"),
    )
    marked = marked.withColumn("html", F.regexp_replace("html", "<tr>", "<tr><td>"))
    lines = all_lines(html_tables(marked, "page_id", "html", _cores(spark)), "page_id")
    return lines.groupBy("page_id", "table_no").agg(F.count("*").alias("items"))


# --- exploring ---------------------------------------------------------------


@query
def station_alias(spark, folder):
    return ex.station_alias(sampling(spark, folder))


@query
def survey_info(spark, folder):
    sheet = ex.survey_names(spark).select(
        "Survey",
        "Abbreviation",
        F.when(F.length("Abbreviation") > 3, F.concat(F.lit("https://example.org/"), "Abbreviation")).alias(
            "Survey_link"
        ),
        F.lit("data").alias("Data_source_name"),
        F.concat(F.lit("https://example.org/data/"), "Abbreviation").alias("Data source 1"),
        F.lit(None).cast("string").alias("Data source 2"),
    )
    table = ex.survey_info(sheet, sampling(spark, folder))
    return table.withColumn(ex.MEAN_EFFORT, F.round(F.col(f"`{ex.MEAN_EFFORT}`"), 6))


@query
def explore_by_year(spark, folder):
    table = sampling(spark, folder)
    return flat(ex.explore(table, None, SOME_SURVEYS, SOME_PARAMETERS, by_year=True))


@query
def explore_average(spark, folder):
    return flat(ex.explore(sampling(spark, folder), None))


@query
def explore_fixed(spark, folder):
    table = sampling(spark, folder)
    return flat(ex.explore(table, None, SOME_SURVEYS, ["Benthic"], exclude_unfixed=True))


@query
def explore_sites(spark, folder):
    table = stage(sampling(spark, folder), "sampling")
    alias = ex.station_alias(table)
    return flat(ex.explore(table, alias, sites=STATION_NAMES, by_year=True))


@query
def plot_rows(spark, folder):
    explored = ex.explore(sampling(spark, folder), None)
    return ex.plot_rows(explored, "Max", 0.5, 2.0).select("Source", "Station", "tooltip")


@query
def plot_rows_year(spark, folder):
    explored = ex.explore(sampling(spark, folder), None, by_year=True)
    return ex.plot_rows(explored, year=SOME_YEAR).select("Source", "Station", "tooltip")


@query
def facet_surveys(spark, folder):
    return ex.surveys_with(sampling(spark, folder), ex.survey_names(spark), ["Benthic"])


@query
def facet_sites(spark, folder):
    alias = ex.station_alias(sampling(spark, folder))
    return ex.sites_of(alias, SOME_SURVEYS, exclude_unfixed=True)


@query
def facet_metrics(spark, folder):
    explored = ex.explore(sampling(spark, folder), None, by_year=True)
    return ex.metric_choices(explored, SOME_SURVEYS)


@query
def metric_range(spark, folder):
    return ex.metric_range(ex.explore(sampling(spark, folder), None), "Max")


@query
def year_range(spark, folder):
    return ex.year_range(sampling(spark, folder))


@query
def bounding_box(spark, folder):
    box = ex.bounding_box(derive(spark, folder, "water_quality"))
    return rounded(box, *box.columns)


@query
def facets(spark, folder):
    """All choices in one pass over the effort table."""
    found = ex.facets(sampling(spark, folder), ["Benthic"], SOME_SURVEYS, exclude_unfixed=True)
    return rounded(found, "low", "high")


@query
def survey_colours(spark, folder):
    return ex.survey_colours(ex.explore(sampling(spark, folder), None, SOME_SURVEYS))


@query
def legend_scale(spark, folder):
    explored = ex.explore(sampling(spark, folder), None)
    scaled = ex.scale_values(explored, "Fish", log=True, low=0.1, high=5, filter_metric="Max")
    return rounded(scaled.select("Source", "Station", "scaled"), "scaled")


@query
def legend_domain(spark, folder):
    explored = ex.explore(sampling(spark, folder), None)
    domain = ex.scale_domain(ex.scale_values(explored, "Water_quality", log=True), "Water_quality")
    return rounded(domain, "min_scaled", "max_scaled")


@query
def legend_breaks(spark, folder):
    explored = ex.explore(sampling(spark, folder), None, by_year=True)
    return ex.scale_breaks(ex.scale_values(explored, "Max", log=True), log=True)


@query
def parameter_rows(spark, folder):
    """The wide table back to rows of its non-zero counts."""
    wide = sampling(spark, folder).select("StationID", "Year", *PARAMETERS)
    return wide.unpivot(["StationID", "Year"], PARAMETERS, "Parameter", "N").filter("N > 0").select(
        "StationID", "Year", readable("Parameter").alias("Parameter"), "N"
    )


@query
def names_in_rows(spark, folder):
    """Several name columns as rows, missing names kept."""
    table = load(spark, folder, "part").select(
        "p_partkey",
        split_part("p_name", " ", 1).alias("first"),
        split_part("p_name", " ", 3).alias("third"),
        F.lower("p_type").alias("kind"),
    )
    return names_to_rows(table, ["p_partkey"], ["first", "third", "kind"], "name")


@query
def names_not_chosen(spark, folder):
    """Set difference and negated membership; missing names stay."""
    named = load(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_orderpriority")).alias("priority"),
        F.col("o_custkey").alias("c_custkey"),
    )
    chosen = load(spark, folder, "customer").filter(F.col("c_acctbal") > 0).select("c_custkey")
    kept = named.filter(not_in_list("priority", ["1-URGENT", "2-HIGH"]))
    return drop_matching(kept, chosen, ["c_custkey"]).select("o_orderkey", "priority")


@query
def null_key_lookup(spark, folder):
    """A missing key finds the missing key."""
    counted = count_rows(
        load(spark, folder, "orders").select(
            F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderstatus")).alias("status")
        ),
        ["status"],
    )
    labels = stack(
        load(spark, folder, "orders").select(F.col("o_orderstatus").alias("status")).distinct(),
        rows(spark, [(None,)], "status string"),
    ).withColumn("label", paste_na(F.lit("status"), "status"))
    return left_lookup(counted, labels, ["status"])


# --- sources and sinks -------------------------------------------------------


@query
def typed_csv(spark, folder):
    """Visits landed as CSV in two column orders, with doubled quotes and more columns
    than are asked for, then scanned."""
    path = run_folder(spark, "visits-csv")
    lines = derive(spark, folder, "ybfmp_zoop").withColumnRenamed("Station", "StationCode")
    cells = {name: F.coalesce(F.col(name), F.lit("NA")) for name in lines.columns}
    cells["StationCode"] = F.concat(F.lit('"say ""'), "StationCode", F.lit('"", then"'))
    early = F.coalesce(F.col("Time") < "12", F.lit(True))
    orders = [
        (["Date", "Time", "StationCode"], early), (["StationCode", "Other", "Time", "Date"], ~early)
    ]
    for order, chosen in orders:
        body = F.concat_ws(",", *[cells.get(name, F.lit("x")) for name in order])
        text = lines.filter(chosen).select(body.alias("value")).repartition(4)
        # Every file begins with its header; numbers restart at each partition.
        numbered = text.withColumn("number", F.monotonically_increasing_id() % (1 << 33))
        headed = F.when(
            F.col("number") == 0, F.array(F.lit(",".join(order)), F.col("value"))
        ).otherwise(F.array("value"))
        with_header = numbered.select(F.explode(headed).alias("value"))
        with_header.write.mode("append").text(path)
    return count_rows(read_csv(spark, path, SURVEYS["ybfmp_zoop"].columns), ["Station", "Time"])


@query
def sheet_scan(spark, folder):
    """The sensor sheet landed as files of two column orders in a folder with a blank in
    its name, then scanned: rows by station, sensor and years."""
    path = run_folder(spark, "sensor sheet")
    sheet = derive(spark, folder, "sensor_sheet")
    for order in (sheet.columns, sheet.columns[::-1]):
        odd = F.col("station_id").substr(-1, 1).isin(*"13579")
        part = sheet.filter(odd if order[0] == sheet.columns[0] else ~odd)
        part.select(F.lit("note, unused").alias("note"), *order).write.mode("append").csv(
            path, header=True, nullValue="NA"
        )
    return (
        read_csv(spark, path, sensors.SHEET_COLUMNS)
        .groupBy("station_name", "station_id", "sensname", F.year("start_date").alias("start_year"))
        .agg(
            F.count("*").alias("N"), F.count("end_date").alias("ended"),
            F.round(F.max("latitude"), 6).alias("latitude"), F.round(F.min("longitude"), 6).alias("longitude"),
        )
    )


def _cores(spark) -> int:
    """Each test table is one row group; its pages are dealt out for reading markup."""
    return spark.sparkContext.defaultParallelism


def dealt(table: DataFrame, most: int) -> DataFrame:
    """The table dealt out to all cores, at most so many rows to a task."""
    return table.repartition(max(_cores(table.sparkSession), -(-table.count() // most)))


@query
def wide_spans(spark, folder):
    """Cells that span more than a thousand rows, in tags of any case. Suppliers are dealt
    out before they are pages, and so that a task sorts few lines for the least cell."""
    body = F.concat(
        F.lit("<tAble><tR><tD rowspan=1500>"), "s_name", F.lit("</Td><td>1</td></tr>"),
        *[F.lit("".join(f"<tr><td>{n}</td></tr>" for n in range(2, 1502)))], F.lit("</TABLE>"),
    )
    suppliers = dealt(load(spark, folder, "supplier").select("s_suppkey", "s_name"), WIDE_PAGES)
    pages = suppliers.select("s_suppkey", body.alias("html"))
    lines = all_lines(html_tables(pages, "s_suppkey", "html"), "s_suppkey")
    return lines.groupBy("s_suppkey", F.size("cells").alias("width")).agg(
        F.count("*").alias("n_lines"), F.min(cell(1)).alias("least_cell"),
        F.max("row_no").alias("last_row"),
    )


@query
def stored_sampling(spark, folder):
    """The effort table stored by Source, one Source replaced in a second run, and two
    read back."""
    path = run_folder(spark, "sampling")
    table = sampling(spark, folder)
    older = F.when(F.col("Source") == "EMP", F.col("Max") + 1).otherwise(F.col("Max"))
    write_sampling(table.withColumn("Max", older), path)
    write_sampling(table.filter(F.col("Source") == "EMP"), path, refresh=True)
    return flat(read_sampling(spark, path).filter(F.col("Source").isin("EMP", "FMWT")))


@query
def packaged_table(spark, folder):
    """A pruned scan of a table that comes as it is."""
    return read_table(spark, f"{folder}/supplier.parquet", "s_suppkey", "s_nationkey")
