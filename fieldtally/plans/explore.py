"""Questions asked of the effort table: selections, yearly averages, plot rows,
scales and the choices on offer. In every function an argument that is None means
no restriction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally.functions.numbers import (
    any_positive,
    half_even,
    log_scale,
    round_ticks,
    unlog_scale,
)
from fieldtally.functions.text import (
    link,
    number_text,
    paste_na,
    readable,
    table_rows_html,
)
from fieldtally.operators.lookups import in_list, keep_matching, left_lookup, not_in_list
from fieldtally.operators.reshape import explode_names, names_to_rows
from fieldtally.operators.tallies import distinct_values, extent_of, stack
from fieldtally.plans.surveys import PARAMETERS
from fieldtally.sources.tables import rows

# Surveys and their abbreviations.
SURVEY_NAMES = [
    ("20-mm Survey (20mm)", "20mm"),
    ("CDFW Bay Study (Baystudy)", "Baystudy"),
    ("Delta Juvenile Fish Monitoring Program (DJFMP)", "DJFMP"),
    ("Enhanced Delta Smelt Monitoring (EDSM)", "EDSM"),
    ("Environmental Monitoring Program (EMP)", "EMP"),
    ("Fall Midwater Trawl (FMWT)", "FMWT"),
    ("Fish Restoration Program (FRP)", "FRP"),
    ("Spring Kodiak Trawl (SKT)", "SKT"),
    ("Smelt Larva Survey", "SLS"),
    ("Summer Townet (STN)", "STN"),
    ("Suisun Marsh Fish Study (Suisun)", "Suisun"),
    ("Bureau of Reclamation Sacramento Ship Channel Surveys (SDSCS)", "SDSCS"),
    ("SFBS San Francisco Bay Survey (SFBS)", "SFBS"),
    ("Yolo Bypass Fish Monitoring Program (YBFMP)", "YBFMP"),
]

# Sites without a fixed place, and how selections name them.
UNFIXED_SITES = ["EZ2", "EZ6", "EZ2-SJR", "EZ6-SJR"]
UNFIXED_ALIASES = ["EMP EZ2", "EMP EZ6", "EMP EZ2-SJR", "EMP EZ6-SJR"]
UNFIXED_SURVEY = "EDSM"
UNFIXED_SURVEY_ALIAS = "Unfixed EDSM stations"

# Metrics besides the parameters, and their titles.
OTHER_METRICS = [("Max", "Max N over all parameters"), ("N_years", "Number of years")]
EFFORT = [*PARAMETERS, "Max"]
STATION_KEYS = [
    "Station", "Station2", "Extra_stations", "Source", "Latitude", "Longitude",
    "Zoop_station", "Benthic_station",
]

# Columns of the survey sheet and of the survey overview.
SURVEY_SHEET_COLUMNS = {
    "Survey": ("Survey", "string"),
    "Abbreviation": ("Abbreviation", "string"),
    "Survey_link": ("Survey_link", "string"),
    "Data_source_name": ("Data_source_name", "string"),
    "Data source 1": ("Data source 1", "string"),
    "Data source 2": ("Data source 2", "string"),
}

# Column titles of the survey table.
TOTAL_YEARS = "Total years of sampling"
MEAN_EFFORT = "Average number of samples per year per station"


def survey_names(spark: SparkSession) -> DataFrame:
    return rows(spark, SURVEY_NAMES, "Survey string, Abbreviation string")


def station_alias(sampling: DataFrame) -> DataFrame:
    """Every name a station can be selected by: Source, StationID, Station.
    Sites without a fixed place have one common name each. Repeats are removed
    before the arrays are opened."""
    fixed = sampling.filter(
        not_in_list("Station", UNFIXED_SITES) & (F.col("Source") != UNFIXED_SURVEY)
    )
    names = explode_names(
        distinct_values(fixed, "Source", "StationID", "Zoop_station", "Benthic_station"),
        "Benthic_station",
    )
    prefixed = names.withColumns(
        {
            c: F.when(F.col(c).isNotNull(), paste_na("Source", c))
            for c in ("Zoop_station", "Benthic_station")
        }
    ).distinct()
    long = names_to_rows(
        prefixed.withColumn("Station", F.col("StationID")),
        ["Source", "StationID"],
        ["Zoop_station", "Benthic_station", "Station"],
        "Station",
    ).filter(F.col("Station").isNotNull())
    common = [(UNFIXED_SURVEY, UNFIXED_SURVEY_ALIAS)] + [("EMP", a) for a in UNFIXED_ALIASES]
    literal = rows(
        sampling.sparkSession,
        [(source, name, name) for source, name in common],
        "Source string, StationID string, Station string",
    )
    return stack(literal, long)


def survey_info(sheet: DataFrame, sampling: DataFrame) -> DataFrame:
    """The survey sheet with what each survey samples, for how long and how
    often, and with its links as anchors."""
    facts = sampling.groupBy("Source").agg(
        *[F.when(F.sum(p) > 0, "Yes").otherwise("").alias(p) for p in PARAMETERS],
        F.max("N_years").alias(TOTAL_YEARS),
        F.avg("Max").alias(MEAN_EFFORT),
    )
    joined = left_lookup(sheet, facts, {"Abbreviation": "Source"})

    def source_link(name: str) -> Column:
        url = F.col(f"`{name}`")
        return F.when(url.isNull(), "").otherwise(link(url, "Data_source_name"))

    return joined.select(
        F.when(F.col("Survey_link").isNull(), F.col("Survey"))
        .otherwise(link("Survey_link", "Survey"))
        .alias("Survey"),
        "Abbreviation",
        *[F.col(p).alias("Water quality" if p == "Water_quality" else p) for p in PARAMETERS],
        F.col(f"`{TOTAL_YEARS}`"),
        F.col(f"`{MEAN_EFFORT}`"),
        *[source_link(name).alias(name) for name in ("Data source 1", "Data source 2")],
    )


def explore(
    sampling: DataFrame,
    alias: DataFrame,
    surveys: Iterable[str] | None = None,
    parameters: Iterable[str] | None = None,
    sites: Iterable[str] | None = None,
    exclude_unfixed: bool = False,
    by_year: bool = False,
) -> DataFrame:
    """Effort rows of the selected surveys, parameters and station names; by year
    or averaged over the years of each station. An empty selection of surveys or
    parameters, like none at all, means all of them."""
    chosen = sampling
    if exclude_unfixed:
        chosen = chosen.filter(not_in_list("Station", UNFIXED_SITES))
    if surveys:
        chosen = chosen.filter(in_list("Source", surveys))
    chosen = chosen.filter(any_positive(_parameters(parameters)))
    if sites is not None:
        chosen = _of_sites(chosen, alias, list(sites))
    return chosen if by_year else _yearly_average(chosen)


def _of_sites(chosen: DataFrame, alias: DataFrame, sites: list[str]) -> DataFrame:
    selected = distinct_values(
        alias.filter(in_list("Station", sites)), "StationID"
    ).withColumn("is_selected", F.lit(True))
    chosen = (
        left_lookup(chosen, selected, ["StationID"])
        .filter(
            F.col("is_selected")
            | (F.col("Source") == UNFIXED_SURVEY)
            | in_list("Station", UNFIXED_SITES)
        )
        .drop("is_selected")
    )
    if UNFIXED_SURVEY_ALIAS not in sites:
        chosen = chosen.filter(F.col("Source") != UNFIXED_SURVEY)
    absent = [
        name for name, long in zip(UNFIXED_SITES, UNFIXED_ALIASES) if long not in sites
    ]
    return chosen.filter(not_in_list("Station", absent)) if absent else chosen


def _yearly_average(chosen: DataFrame) -> DataFrame:
    """Sums divided by the years of the station over all parameters."""
    summed = chosen.groupBy(*STATION_KEYS).agg(
        *[F.sum(c).alias(c) for c in EFFORT], F.max("N_years").alias("N_years")
    )
    return summed.withColumns({c: half_even(F.col(c) / F.col("N_years"), 2) for c in EFFORT})


def effort_between(
    explored: DataFrame, metric: str = "Max", low: float | None = None, high: float | None = None
) -> DataFrame:
    """Rows whose metric lies in the range, both ends included."""
    if low is not None:
        explored = explored.filter(F.col(metric) >= low)
    if high is not None:
        explored = explored.filter(F.col(metric) <= high)
    return explored


def plot_rows(
    explored: DataFrame,
    metric: str = "Max",
    low: float | None = None,
    high: float | None = None,
    year: int | None = None,
) -> DataFrame:
    """Rows to show, with their pop-up text. A year asks for the rows of that year
    of a result by year; without one the result is taken as averages."""
    shown = effort_between(explored, metric, low, high)
    lines = [
        ("Survey", paste_na("Source")),
        ("Station", paste_na("Station")),
        ("Alternate station names", F.coalesce("Extra_stations", F.lit("None"))),
        *[(f"N_{p}", number_text(p)) for p in sorted(PARAMETERS)],
        ("N_Max", number_text("Max")),
        ("N_Years", number_text("N_years")),
    ]
    if year is not None:
        shown = shown.filter(F.col("Year") == year)
        lines.insert(0, ("Year", paste_na("Year")))
    return shown.withColumn("tooltip", table_rows_html(lines))


def surveys_with(
    sampling: DataFrame, names: DataFrame, parameters: Iterable[str] | None = None
) -> DataFrame:
    """Surveys that sampled any of the parameters."""
    sources = distinct_values(sampling.filter(any_positive(_parameters(parameters))), "Source")
    return keep_matching(names, sources, {"Abbreviation": "Source"})


def sites_of(
    alias: DataFrame, surveys: Iterable[str] | None = None, exclude_unfixed: bool = False
) -> DataFrame:
    """Station names to choose from."""
    if surveys:
        alias = alias.filter(in_list("Source", surveys))
    if exclude_unfixed:
        alias = alias.filter(not_in_list("Station", UNFIXED_ALIASES))
    return alias.select("Station")


def metric_choices(explored: DataFrame, surveys: Iterable[str] | None = None) -> DataFrame:
    """Metrics to choose from, in order: position, metric, label. Parameters are
    on offer if they occur in the rows of the surveys; without any rows all are.
    One aggregate reads the rows; its single row is opened into the choices."""
    counted = in_list("Source", surveys) if surveys else F.lit(True)
    facts = explored.agg(
        F.count("*").alias("rows"),
        *[F.bool_or(counted & (F.col(p) > 0)).alias(p) for p in PARAMETERS],
    )
    occurring = F.array_compact(
        F.array(*[F.when(F.col(p), _choice(p)) for p in sorted(PARAMETERS)])
    )
    everything = F.array(*[_choice(p) for p in PARAMETERS])
    others = F.array(*[_choice(metric, title) for metric, title in OTHER_METRICS])
    offered = F.concat(F.when(F.col("rows") == 0, everything).otherwise(occurring), others)
    return facts.select(F.posexplode(offered).alias("at", "choice")).select(
        (F.col("at") + 1).alias("position"), "choice.metric", "choice.label"
    )


def metric_range(explored: DataFrame, metric: str = "Max") -> DataFrame:
    return extent_of(explored, effort=metric)


def year_range(sampling: DataFrame) -> DataFrame:
    return extent_of(sampling, year="Year")


def bounding_box(sampling: DataFrame) -> DataFrame:
    return extent_of(sampling, lon="Longitude", lat="Latitude")


def facets(
    sampling: DataFrame,
    parameters: Iterable[str] | None = None,
    surveys: Iterable[str] | None = None,
    exclude_unfixed: bool = False,
    metric: str = "Max",
) -> DataFrame:
    """Everything there is to choose from, in one pass over the effort table: ``facet,
    name, label, rank, low, high``.

    Facets are ``survey`` (those that sample any of the ``parameters``), ``site`` (names
    in the ``surveys``), ``metric`` (those that occur in the ``surveys``, in the order of
    ``rank``), ``effort`` (range of the averaged ``metric``), ``year``, ``longitude`` and
    ``latitude`` (ranges). Years of a station are added up first; each station then
    contributes its few entries to one aggregate by facet and name. Without rows only
    the common names of sites without a fixed place are left."""
    positive = any_positive(PARAMETERS)
    stations = sampling.groupBy(*STATION_KEYS, "StationID").agg(
        *[F.sum(F.when(positive, F.col(c))).alias(c) for c in EFFORT],
        F.bool_or(any_positive(_parameters(parameters))).alias("chosen"),
        *[F.bool_or(F.col(p) > 0).alias(f"any_{p}") for p in PARAMETERS],
        F.max("N_years").alias("N_years"),
        F.min("Year").alias("first_year"),
        F.max("Year").alias("last_year"),
    )
    listed = in_list("Source", surveys) if surveys else F.lit(True)
    fixed = not_in_list("Station", UNFIXED_SITES) & (F.col("Source") != UNFIXED_SURVEY)
    names = F.concat(
        F.array("StationID", F.when(F.col("Zoop_station").isNotNull(), paste_na("Source", "Zoop_station"))),
        F.coalesce(
            F.transform("Benthic_station", lambda n: F.when(n.isNotNull(), F.concat("Source", F.lit(" "), n))),
            F.array().cast("array<string>"),
        ),
    )
    sites = F.when(listed & fixed, F.filter(names, lambda n: n.isNotNull()))
    effort = half_even(F.col(metric) / F.col("N_years"), 2)
    entries = F.concat(
        F.array(
            _entry("survey", F.when(F.col("chosen"), F.col("Source"))),
            *[_entry("metric", F.when(listed & F.col(f"any_{p}"), F.lit(p))) for p in PARAMETERS],
            *[_entry("metric", F.lit(name)) for name, _ in OTHER_METRICS],
            _entry("effort", F.lit(metric), effort),
            _entry("year", F.lit("Year"), F.col("first_year"), F.col("last_year")),
            _entry("longitude", F.lit("Longitude"), F.col("Longitude")),
            _entry("latitude", F.lit("Latitude"), F.col("Latitude")),
        ),
        F.transform(F.coalesce(sites, F.array().cast("array<string>")), lambda n: _entry("site", n)),
    )
    found = (
        stations.select(F.explode(entries).alias("entry"))
        .select("entry.*")
        .filter(F.col("name").isNotNull())
        .groupBy("facet", "name")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
    )
    common = [] if surveys and UNFIXED_SURVEY not in surveys else [UNFIXED_SURVEY_ALIAS]
    if not exclude_unfixed and (not surveys or "EMP" in surveys):
        common += UNFIXED_ALIASES
    literal = rows(sampling.sparkSession, [("site", name) for name in common], "facet string, name string")
    ranked = [*sorted(PARAMETERS), *[name for name, _ in OTHER_METRICS]]
    titles = dict(OTHER_METRICS)
    survey = _looked_up({short: F.lit(long) for long, short in SURVEY_NAMES})
    title = _looked_up({m: F.lit(titles[m]) if m in titles else readable(F.lit(m)) for m in ranked})
    rank = _looked_up({m: F.lit(at) for at, m in enumerate(ranked, start=1)})
    return (
        stack(found, literal)
        .withColumns({
            "label": F.when(F.col("facet") == "survey", survey).when(F.col("facet") == "metric", title),
            "rank": F.when(F.col("facet") == "metric", rank),
        })
        .filter((F.col("facet") != "survey") | F.col("label").isNotNull())
        .select("facet", "name", "label", "rank", "low", "high")
    )


def _entry(facet: str, name: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """What a station contributes to a facet; a null name contributes nothing."""
    low = F.lit(None) if low is None else low
    values = [(low if c is None else c).cast("double") for c in (low, high)]
    return F.struct(
        F.lit(facet).alias("facet"), name.alias("name"), values[0].alias("low"), values[1].alias("high")
    )


def _looked_up(values: dict[str, Column]) -> Column:
    pairs = [part for name, value in values.items() for part in (F.lit(name), value)]
    return F.try_element_at(F.create_map(*pairs), F.col("name"))


def scale_values(
    explored: DataFrame,
    metric: str = "Max",
    log: bool = False,
    low: float | None = None,
    high: float | None = None,
    filter_metric: str | None = None,
) -> DataFrame:
    """The rows in the effort range with ``scaled``, the value that decides their
    colour."""
    value = F.col(metric).cast("double")
    return effort_between(explored, filter_metric or metric, low, high).withColumn(
        "scaled", log_scale(value) if log else value
    )


def scale_domain(scaled: DataFrame, metric: str = "Max") -> DataFrame:
    """Lowest and highest scaled value, and the title of the legend."""
    return extent_of(scaled, scaled="scaled").withColumn("title", legend_title(F.lit(metric)))


def scale_breaks(scaled: DataFrame, log: bool = False, intervals: int = 7) -> DataFrame:
    """Legend labels, highest first: round ticks over the range of the scaled values,
    about ``intervals`` of them, on the original scale. One aggregate reads the rows."""
    domain = extent_of(scaled, scaled="scaled")
    ticks = domain.select(
        F.explode(round_ticks(F.col("min_scaled"), F.col("max_scaled"), intervals)).alias("tick")
    )
    label = unlog_scale(F.col("tick")) if log else F.col("tick")
    return ticks.select(label.alias("label")).orderBy(F.desc("label"))


def legend_title(metric: Column) -> Column:
    # Fixed value: the wording of the title.
    effort = paste_na(readable(metric), F.lit(" effort</br>(samples per year)"), sep="")
    return F.when(metric.isin(EFFORT), effort).otherwise(readable(metric))


def survey_colours(explored: DataFrame) -> DataFrame:
    """The surveys that need a colour."""
    return distinct_values(explored, "Source")


def _choice(metric: str, title: str | None = None) -> Column:
    label = F.lit(title) if title else readable(F.lit(metric))
    return F.struct(F.lit(metric).alias("metric"), label.alias("label"))


def _parameters(chosen: Iterable[str] | None) -> list[str]:
    return list(chosen) if chosen else PARAMETERS
