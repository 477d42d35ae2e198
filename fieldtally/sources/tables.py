"""Typed and pruned scans, parameterised sources, literal rows and the result
sink."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldtally.sources.staging import run_folder

# Where a stored table keeps its rows and its schema.
DATA, SCHEMA = "rows", "schema"
# Headers of files (some hundred bytes each) that may be broadcast to the lines.
FILES_AT_ONCE = 50_000


def read_csv(
    spark: SparkSession,
    path: str,
    columns: Mapping[str, tuple[str, str]],
    multi_line: bool = False,
) -> DataFrame:
    """CSV scan of a file or folder that keeps the named file columns only, as
    ``{file column: (new name, type)}``. Everything is read as text and cast by
    name; a value that does not fit its type, an empty field and the word NA are
    null. Quotes inside quoted fields are doubled.

    Files may order their columns differently: each is read by its own header, in one
    scan that parses only the places at which a wanted column stands in some file. Where
    those are the same in all files nothing is joined; where not, a table of the files'
    headers comes to the lines. A file that lacks a wanted column is an error; empty
    files have no rows. ``multi_line`` allows line breaks inside quoted fields (not in
    the header); such files cannot be split, so each is one task."""
    headers = _headers(spark, path)
    standing = headers.agg(
        F.count("*").alias("files"),
        F.max(F.size("cells")).alias("width"),
        *[F.sort_array(F.collect_set(_place(name))).alias(f"at_{i}") for i, name in enumerate(columns)],
    ).first()
    if not standing["files"]:
        kinds = ", ".join(f"`{new}` {kind}" for new, kind in columns.values())
        return spark.createDataFrame([], kinds)
    places = {name: standing[f"at_{i}"] for i, name in enumerate(columns)}
    missing = [name for name, at in places.items() if 0 in at]
    if missing:
        raise ValueError(f"no column {missing} in some file of {path}")
    lines = spark.read.schema(", ".join(f"`{_slot(i + 1)}` string" for i in range(standing["width"]))).csv(
        path,
        header=True,
        quote='"',
        escape='"',
        multiLine=multi_line,
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )
    if any(len(at) > 1 for at in places.values()):
        by_file = headers.select("file", *[_place(name).alias(f"__at_{i}") for i, name in enumerate(columns)])
        if standing["files"] <= FILES_AT_ONCE:
            by_file = F.broadcast(by_file)
        lines = lines.withColumn("file", F.col("_metadata.file_path")).join(by_file, "file")
    cells = []
    for i, (name, at) in enumerate(places.items()):
        value = F.col(_slot(at[0]))
        if len(at) > 1:
            value = F.coalesce(*[F.when(F.col(f"__at_{i}") == p, F.col(_slot(p))) for p in at])
        cells.append(_cell(value).try_cast(columns[name][1]).alias(columns[name][0]))
    return lines.select(*cells)


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """``file, cells`` of every file that is not empty, written once. A session of its own
    gives every split a task and takes one line from it, so that no file is read
    through."""
    reader, cost = spark.newSession(), "spark.sql.files.openCostInBytes"
    limit = reader.conf.get("spark.sql.files.maxPartitionBytes")
    reader.conf.set(cost, limit)
    alone = reader.conf.get(cost) == limit
    if alone:
        reader.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    lines = reader.read.text(path).filter(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        "value",
    )
    written = run_folder(spark, "csv-headers")
    schema = "file string, cells array<string>"
    lines.mapInArrow(_first_lines(alone), schema).write.parquet(written)
    return spark.read.schema(schema).parquet(written)


def _first_lines(alone: bool):
    """The header, in cells, of each file that begins in a task. A task that holds a
    single split is done after its first line."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            for file, start, line in zip(*(c.to_pylist() for c in batch.columns)):
                if start == 0 and file != seen:
                    cells = next(csv.reader([line.lstrip("\ufeff")], skipinitialspace=True))
                    named = pa.array([[c.strip() for c in cells]], type=pa.list_(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array([file]), named], ["file", "cells"])
                seen = file
                if alone:
                    return

    return first


def _place(name: str) -> Column:
    """Where a column stands in a file, from 1; 0 if it does not."""
    return F.array_position("cells", F.lit(name)).cast("int")


def _slot(place: int) -> str:
    return f"__{place}"


def read_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Parquet scan, pruned to the named columns if there are any."""
    table = spark.read.parquet(path)
    return table.select(*columns) if columns else table


def survey_years(
    table: DataFrame,
    start_year: int | None = None,
    end_year: int | None = None,
    sources: Iterable[str] | None = None,
    regions: Iterable[str] | None = None,
    date: str | None = None,
) -> DataFrame:
    """Restrict an integrated table to years, sources and regions; an argument
    left out does not restrict. With ``date`` the year bounds are put on the
    date itself, so that they reach the Parquet scan as range filters."""
    if start_year is not None:
        table = table.filter(_from_year(start_year, date))
    if end_year is not None:
        table = table.filter(_before_year(end_year + 1, date))
    if sources is not None:
        table = table.filter(F.col("Source").isin(list(sources)))
    if regions is not None:
        table = table.filter(F.col("Region").isin(list(regions)))
    return table


def variables_between(
    tables: Mapping[str, DataFrame],
    start_year: int,
    end_year: int,
    regions: Iterable[str] | None = None,
    starts: Mapping[str, int] | None = None,
    date: str = "Date",
) -> dict[str, DataFrame]:
    """The same restriction for several variables at once; ``starts`` overrides
    the first year of single variables."""
    starts = starts or {}
    return {
        name: survey_years(table, starts.get(name, start_year), end_year, None, regions, date)
        for name, table in tables.items()
    }


def rows(spark: SparkSession, values: list[tuple], schema: str) -> DataFrame:
    """A small literal table."""
    return spark.createDataFrame(values, schema)


def write_sampling(table: DataFrame, path: str, refresh: bool = False) -> None:
    """Store the effort table by Source, its schema beside it. The rebalance hint lets
    adaptive execution cut a very large Source into several files and merge small ones.

    With ``refresh`` only the Sources that occur in ``table`` are replaced; the files of
    the others stay as they are. Its schema must be the stored one."""
    spark = table.sparkSession
    if refresh:
        stored, given = sampling_schema(spark, path), _nullable(table.schema)
        if {f.name: f.dataType for f in stored} != {f.name: f.dataType for f in given}:
            raise ValueError(f"columns of the refresh differ from those stored in {path}")
        table = table.select(*stored.names)
    else:
        _write_schema(spark, _nullable(table.schema), path)
    table.hint("rebalance", "Source").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic" if refresh else "static"
    ).partitionBy("Source").parquet(f"{path}/{DATA}")


def read_sampling(spark: SparkSession, path: str) -> DataFrame:
    """The stored effort table, by the schema stored with it: no file is opened to learn
    it, and Source, which is kept in folder names, has its own type."""
    schema = sampling_schema(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{DATA}").select(*schema.names)


def sampling_schema(spark: SparkSession, path: str) -> StructType:
    text = spark.read.text(f"{path}/{SCHEMA}", wholetext=True).first()["value"]
    return StructType.fromJson(json.loads(text))


def _write_schema(spark: SparkSession, schema: StructType, path: str) -> None:
    line = spark.createDataFrame([(schema.json(),)], "value string")
    line.coalesce(1).write.mode("overwrite").text(f"{path}/{SCHEMA}")


def _nullable(schema: StructType) -> StructType:
    """As Parquet gives it back: every column may be null."""
    plain = schema.jsonValue()
    for field in plain["fields"]:
        field["nullable"] = True
    return StructType.fromJson(plain)


def _cell(value: Column) -> Column:
    return F.when(~value.isin("", "NA"), value)


def _from_year(year: int, date: str | None):
    return F.col("Year") >= year if date is None else F.col(date) >= _new_year(year)


def _before_year(year: int, date: str | None):
    return F.col("Year") < year if date is None else F.col(date) < _new_year(year)


def _new_year(year: int):
    return F.lit(f"{year:04d}-01-01").cast("timestamp_ntz")
