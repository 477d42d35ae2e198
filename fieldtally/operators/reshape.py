"""Long to wide, wide to long, and filling of year ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wide_count(
    name_column: str, name: str, value_column: str, on_duplicate: str = "error"
) -> Column:
    """Aggregate for one cell of a long-to-wide reshape: the value of the rows
    named ``name``, 0 if there is none. With the names known beforehand one such
    aggregate for each needs a single shuffle.

    ``on_duplicate`` says what several values for one cell mean: ``error``,
    ``sum`` or ``max``."""
    here = F.col(name_column) == name
    value = F.when(here, F.col(value_column))
    if on_duplicate == "sum":
        filled = F.sum(value)
    elif on_duplicate == "max":
        filled = F.max(value)
    elif on_duplicate == "error":
        message = F.lit(f"more than one {value_column} for {name}")
        filled = F.when(F.count_if(here) > 1, F.raise_error(message).cast("long")).otherwise(
            F.max(value)
        )
    else:
        raise ValueError(f"on_duplicate: {on_duplicate}")
    return F.coalesce(filled, F.lit(0).cast("long"))


def names_to_rows(
    table: DataFrame, ids: list[str], columns: list[str], value: str
) -> DataFrame:
    """Wide to long; the column names themselves are not kept, nulls are."""
    return table.unpivot(ids, columns, "column_name", value).drop("column_name")


def complete_years(
    table: DataFrame, keys: list[str], start: str, end: str, year: str = "Year"
) -> DataFrame:
    """For each group every year from the first to the last of its starts and ends,
    whichever comes first in a row. Rows that start in the same year of a group all
    stay; a row without a start year has no span and is left out.

    Rows are counted by group and start year first, so what comes together for a
    group is one entry per year at most."""
    starts = table.filter(F.col(start).isNotNull()).groupBy(*keys, start).agg(
        F.count("*").alias("rows"),
        F.min(F.least(start, end)).alias("first_year"),
        F.max(F.greatest(start, end)).alias("last_year"),
    )
    spans = starts.groupBy(*keys).agg(
        F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"),
        F.map_from_entries(F.collect_list(F.struct(start, "rows"))).alias("rows_by_year"),
    )
    years = spans.select(
        *keys, "rows_by_year", F.explode(F.sequence("first_year", "last_year")).alias(year)
    )
    copies = F.coalesce(F.try_element_at("rows_by_year", year), F.lit(1)).cast("int")
    return years.select(*keys, year, F.explode(F.array_repeat(F.lit(1), copies))).drop("col")


def explode_names(table: DataFrame, column: str) -> DataFrame:
    """One row per array element; a null or empty array keeps its row."""
    return table.withColumn(column, F.explode_outer(column))
