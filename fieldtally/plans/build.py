"""The whole batch: every input table to the final effort table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from fieldtally.plans.matrix import effort_matrix, merge_tallies
from fieldtally.plans.names import alias_directory, harmonise, match_sites
from fieldtally.plans.surveys import (
    FIRST_YEAR,
    LAST_YEAR,
    SURVEYS,
    WATER_QUALITY_SOURCES,
    benthic,
    fish,
    larval_sites,
    merge_datasets,
    phytoplankton,
    summarise_survey,
    water_quality,
    with_zooplankton,
    zooplankton,
)
from fieldtally.operators.tallies import stack
from fieldtally.sources.staging import stage, stage_together
from fieldtally.sources.tables import survey_years, variables_between


def survey_tally(name: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Tally of a survey that comes as its own file. Input tables have the columns
    that ``Survey.columns`` and ``Survey.sites`` produce."""
    survey = SURVEYS[name]
    if name == "edsm":
        return summarise_survey(stack(inputs["edsm_20mm"], inputs["edsm_kdtr"]), survey)
    if name == "sls":
        return summarise_survey(inputs["sls_fish"], survey, larval_sites(inputs["sls_sites"]))
    if name == "djfmp":
        return summarise_survey(inputs["djfmp_seine"], survey, inputs["djfmp_sites"])
    sites = inputs[f"{name}_sites"]
    return summarise_survey(
        inputs[name], survey, sites.distinct() if name == "ybfmp_fish" else sites
    )


def refuse_duplicates(tally: DataFrame) -> None:
    """Raise an error that names the first cells with several values."""
    clashes = (
        tally.groupBy("Source", "Station", "Station2", "Year").count().filter("count > 1")
        .orderBy("Source", "Station", "Station2", "Year").limit(5).collect()
    )
    if clashes:
        named = ", ".join(f"{r['Source']} {r['Station']} {r['Year']}" for r in clashes)
        raise ValueError(f"more than one tally for {named}; choose on_duplicate sum or max")


def sampling_table(inputs: Mapping[str, DataFrame], on_duplicate: str = "error") -> DataFrame:
    """The effort table. What several parts read is written once and read back:
    two survey tallies and that of the zooplankton samples, at the same time, the water
    quality tally, which feeds five of the parts,
    the site matches and the harmonised zooplankton tally. Water quality visits are
    scanned a second time for the sites that move, bivalve samples for their names.

    Two zooplankton sites may be matched to one water quality site. Unless
    ``on_duplicate`` says what that means, such cells are looked for in the small
    tally, before the table is built, and reported."""
    surveys = {name: survey_tally(name, inputs) for name in SURVEYS}
    first = stage_together(
        ybfmp_fish=surveys["ybfmp_fish"],
        ybfmp_zoop=surveys["ybfmp_zoop"],
        zoop_env=zooplankton(inputs["zoop_env"]),
    )
    surveys |= {name: first[name] for name in ("ybfmp_fish", "ybfmp_zoop")}
    integrated = survey_years(
        inputs["water_quality"], end_year=LAST_YEAR, sources=WATER_QUALITY_SOURCES
    )
    samples = variables_between(
        {name: inputs[name] for name in ("bivalves", "phytoplankton")}, FIRST_YEAR, LAST_YEAR
    )
    ybfmp = merge_datasets(surveys["ybfmp_fish"], surveys["ybfmp_zoop"])
    quality = stage(
        water_quality(integrated, surveys["edsm"], surveys["djfmp"], ybfmp, surveys["sls"]),
        "water_quality",
    )
    matches = stage(match_sites(inputs["zoop_sites"], quality), "station_matches")
    zooplankton_tally = stage(
        harmonise(with_zooplankton(first["zoop_env"], surveys["ybfmp_zoop"]), matches), "zooplankton"
    )
    if on_duplicate == "error":
        refuse_duplicates(zooplankton_tally)
    merged = merge_tallies(
        benthic(samples["bivalves"], quality),
        phytoplankton(samples["phytoplankton"], quality),
        zooplankton_tally,
        quality,
        fish(quality, surveys["ybfmp_fish"]),
    )
    return effort_matrix(merged, alias_directory(matches, samples["bivalves"]), on_duplicate)
