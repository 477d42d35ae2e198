"""Counting visits. Every step aggregates before it shuffles, and no step needs
all rows of one station, year or source in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.functions.numbers import strict_sum
from fieldtally.operators.lookups import keep_matching, left_lookup

COORDINATES = ["Latitude", "Longitude"]


def stack(*tables: DataFrame) -> DataFrame:
    """Union by column name; columns absent from a table are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def count_rows(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(F.count("*").alias("N"))


def count_with_mean_place(table: DataFrame, keys: list[str]) -> DataFrame:
    return table.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in COORDINATES], F.count("*").alias("N")
    )


def count_at_each_place(
    table: DataFrame, keys: list[str], weight: str | None = None
) -> DataFrame:
    """The total of each group, repeated for each distinct coordinate pair in the
    group.

    A set of coordinates per group could grow without bound at one station, so
    the pairs are counted as rows of their own first. Nearly all groups have one
    pair, whose count is the total; only the totals of the others are joined back,
    a table so small that adaptive execution broadcasts it."""
    amount = F.count("*") if weight is None else strict_sum(F.col(weight))
    places = table.groupBy(*keys, *COORDINATES).agg(amount.alias("at_place"))
    totals = places.groupBy(*keys).agg(
        strict_sum(F.col("at_place")).alias("N"), F.count("*").alias("places")
    ).filter("places > 1")
    joined = left_lookup(places, totals, keys)
    total = F.when(F.col("places").isNotNull(), F.col("N")).otherwise(F.col("at_place"))
    return joined.withColumn("N", total).drop("at_place", "places")


def split_moving(
    table: DataFrame, keys: list[str], label: str, moved_label: Column
) -> DataFrame:
    """Counts per group; groups recorded at more than one latitude or longitude
    are first taken apart by replacing ``label`` with ``moved_label``.

    Groups that stay in one place, nearly all of them, are finished by the first
    aggregation. Only the rows of the others are read again and shuffled. Groups
    that move have two rows at least; saying so makes both branches use the same
    columns of the aggregate, and its shuffle is reused."""
    extent = table.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in COORDINATES],
        *[F.max(c).alias(f"most_{c}") for c in COORDINATES],
        F.count("*").alias("N"),
    )
    differs = [F.col(c) != F.col(f"most_{c}") for c in COORDINATES]
    moved = reduce(lambda a, b: a | b, differs) & (F.col("N") > 1)
    settled = extent.filter(~moved).select(*keys, *COORDINATES, "N")
    moving = keep_matching(table, extent.filter(moved), keys)
    taken_apart = count_at_each_place(moving.withColumn(label, moved_label), keys)
    return stack(settled, taken_apart.select(settled.columns))


def distinct_values(table: DataFrame, *columns: str) -> DataFrame:
    return table.select(*columns).distinct()


def collect_names(table: DataFrame, key: str, name: str) -> DataFrame:
    """The sorted distinct names of each key as an array. Repeats are removed
    before the names come together, so an array is only as long as its result."""
    return (
        distinct_values(table, key, name)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(name)).alias(name))
    )


def extent_of(table: DataFrame, **columns: str) -> DataFrame:
    """One row with ``min_<name>`` and ``max_<name>`` of each column."""
    edges = []
    for name, column in columns.items():
        edges += [F.min(column).alias(f"min_{name}"), F.max(column).alias(f"max_{name}")]
    return table.agg(*edges)
