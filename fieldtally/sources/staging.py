"""Intermediate results that several later plans read are written once, to the
folder the cluster shares, so that losing an executor loses no work and no plan
repeats the scan of the raw visits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or else the folder given to
    ``SparkContext.setCheckpointDir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.sparkContext.getCheckpointDir()
    )
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one written table."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/{application}/{name}-{uuid.uuid4().hex}"


def stage(table: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write the table and return a scan of what was written; a filter on ``by``, which
    has few values, then reads the rows of one value only."""
    spark = table.sparkSession
    path = run_folder(spark, name)
    table.write.parquet(path, partitionBy=by)
    return spark.read.schema(table.schema).parquet(path)


def stage_in_batches(table: DataFrame, name: str, rows: int) -> DataFrame:
    """``stage`` with at most so many rows at once on their way to Python workers."""
    conf = table.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    most = int(before)
    conf.set(key, str(min(rows, most) if most > 0 else rows))
    try:
        return stage(table, name)
    finally:
        conf.set(key, before)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Meanwhile the shuffle files of each query are deleted when it ends, not when the
    driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stage_together(**tables: DataFrame) -> dict[str, DataFrame]:
    """Stage tables that do not depend on each other at the same time: while one waits
    for its last tasks, the others use the free cores."""
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        written = {name: pool.submit(stage, table, name) for name, table in tables.items()}
        return {name: future.result() for name, future in written.items()}


def unstage(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete what ``stage`` wrote for these tables, once no later plan reads it."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    jvm = spark.sparkContext._jvm
    for table in tables:
        folders = {name.rsplit("/", 1)[0] for name in table.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
