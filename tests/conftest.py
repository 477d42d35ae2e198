from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check import connect, session  # noqa: E402

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    found = session("4")
    yield found
    found.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(SMALLEST)


@pytest.fixture(scope="session")
def frame(spark):
    """A small table from tuples and a schema text."""

    def make(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return make


@pytest.fixture(scope="session")
def tuples():
    """Rows of named columns, sorted."""

    def read(table, *columns):
        rows = table.select(*columns).collect() if columns else table.collect()
        return sorted((tuple(r) for r in rows), key=repr)

    return read
