"""Joins and membership tests with the null rules of the source data: a missing
key matches a missing key, and a missing value is a member of no list.

No join is hinted: the planner and adaptive execution broadcast a side only when
its size is below the session's threshold, and split skewed partitions
otherwise."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_lookup(
    left: DataFrame, right: DataFrame, keys: Iterable[str] | Mapping[str, str]
) -> DataFrame:
    """Left join that adds the other columns of ``right``. ``keys`` are common
    names, or ``{left name: right name}``. Rows fan out if a key repeats."""
    pairs = _pairs(keys)
    hidden = {b: _hidden(b) for b in pairs.values()}
    side = right.withColumnsRenamed(hidden)
    return left.join(side, _equal(pairs), "left").drop(*hidden.values())


def keep_matching(
    left: DataFrame, right: DataFrame, keys: Iterable[str] | Mapping[str, str]
) -> DataFrame:
    """Semi join."""
    return _existence(left, right, keys, "left_semi")


def drop_matching(
    left: DataFrame, right: DataFrame, keys: Iterable[str] | Mapping[str, str]
) -> DataFrame:
    """Anti join."""
    return _existence(left, right, keys, "left_anti")


def full_directory(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join on one key, null keys matching each other."""
    side = right.withColumnRenamed(key, _hidden(key))
    joined = left.join(side, _equal({key: key}), "full")
    payload = [c for c in left.columns + right.columns if c != key]
    return joined.select(F.coalesce(key, _hidden(key)).alias(key), *payload)


def in_list(value: Column | str, values: Iterable[str]) -> Column:
    """Membership that is false, not null, for a missing value."""
    value = F.col(value) if isinstance(value, str) else value
    values = list(values)
    return F.coalesce(value.isin(values), F.lit(False)) if values else F.lit(False)


def not_in_list(value: Column | str, values: Iterable[str]) -> Column:
    return ~in_list(value, values)


def with_coordinates(table: DataFrame) -> DataFrame:
    """Rows with both coordinates."""
    return table.dropna(subset=["Latitude", "Longitude"])


def _existence(left, right, keys, how):
    pairs = _pairs(keys)
    side = right.select(*[F.col(f"`{b}`").alias(_hidden(b)) for b in pairs.values()])
    return left.join(side, _equal(pairs), how)


def _pairs(keys: Iterable[str] | Mapping[str, str]) -> dict[str, str]:
    return dict(keys) if isinstance(keys, Mapping) else {k: k for k in keys}


def _hidden(name: str) -> str:
    return f"__{name}"


def _equal(pairs: dict[str, str]) -> Column:
    tests = [F.col(f"`{a}`").eqNullSafe(F.col(f"`{_hidden(b)}`")) for a, b in pairs.items()]
    return reduce(lambda x, y: x & y, tests)
