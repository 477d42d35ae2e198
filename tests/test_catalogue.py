from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from check import compare
from tests.conftest import SMALLEST


@pytest.mark.parametrize("name", list(entry_points.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    assert compare(spark, duck, SMALLEST, name) == ""


def test_every_query_has_sql():
    ours = {n for n in entry_points.queries() if n != "pipeline" and not n.startswith("op")}
    assert ours <= set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
