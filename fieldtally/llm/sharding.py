"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns several points of a ring; a row belongs to the first point
clockwise of its own hash. A shard takes rows up to its bound; what overflows
continues clockwise to the next shard with room. Rows of one arc of the ring
prefer the shards in the same order, so the walk needs only the number of rows
of each arc: a table of ``shards * points`` rows, whatever the corpus holds. The
rows themselves are ranked inside their arc and looked up in the quotas that the
walk gives, which costs one shuffle of narrow rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

QUOTAS = "ring_arc int, first_rank long, end_rank long, shard int, first_slot long"


def ring_points(shards: int, points: int) -> tuple[np.ndarray, list[int]]:
    """Sorted positions of the virtual nodes, and the shard of each."""
    placed = sorted(
        (xxhash.xxh64_intdigest(f"{shard}:{point}") - 2**63, shard)
        for shard in range(shards)
        for point in range(points)
    )
    return np.array([p for p, _ in placed], dtype=np.int64), [s for _, s in placed]


def clockwise(owners: list[int], shards: int) -> list[list[int]]:
    """For each arc, all shards in the order met when walking on from it."""
    orders: list[list[int]] = []
    for start in range(len(owners)):
        order, seen = [], set()
        for step in range(len(owners)):
            shard = owners[(start + step) % len(owners)]
            if shard not in seen:
                seen.add(shard)
                order.append(shard)
                if len(order) == shards:
                    break
        orders.append(order)
    return orders


def capacities(total: int, shards: int, slack: float) -> list[int]:
    """Bounds of the shards. Without slack they differ by at most one and add up
    to the number of rows, so that every shard ends up full."""
    if slack > 0:
        return [int(np.ceil((1 + slack) * total / shards))] * shards
    return [total // shards + (shard < total % shards) for shard in range(shards)]


def walk(counts: dict[int, int], orders: list[list[int]], room: list[int]) -> list[tuple]:
    """Quotas ``(arc, first rank, end rank, shard, first slot)``. In round t every
    arc with rows left offers them to the t-th shard of its walk, arcs in ring
    order; a shard takes what still fits."""
    left, taken = dict(counts), {arc: 0 for arc in counts}
    room, filled, quotas = list(room), [0] * len(room), []
    for step in range(len(room)):
        for arc in sorted(a for a, n in left.items() if n):
            shard = orders[arc][step]
            part = min(left[arc], room[shard])
            if part:
                quotas.append((arc, taken[arc], taken[arc] + part, shard, filled[shard]))
                taken[arc] += part
                left[arc] -= part
                room[shard] -= part
                filled[shard] += part
    return quotas


def bounded_ring(
    rows: DataFrame,
    position: Column,
    shards: int = 40,
    points: int = 64,
    slack: float = 0.0,
    ties: list[str] | None = None,
) -> DataFrame:
    """``rows`` with ``home_shard`` (the shard without any bound), ``shard`` and
    ``slot`` (gapless from 0 in each shard).

    ``position`` is a 64-bit hash of the row's key. ``slack`` is the share by
    which a shard may exceed the mean; at 0 the counts differ by at most one and
    more keys move when shards are added. Rows at the same position are ordered
    by the columns ``ties``; rows that are equal in these too are interchangeable.
    An empty table gives an empty result; columns of these names are replaced."""
    spark = rows.sparkSession
    places, owners = ring_points(shards, points)

    @F.pandas_udf(T.IntegerType())
    def arc_of(hashes: pd.Series) -> pd.Series:
        found = np.searchsorted(places, hashes.to_numpy(np.int64))
        return pd.Series(found % len(places), dtype="int32")

    plain = rows.drop("home_shard", "shard", "slot")
    placed = plain.withColumn("ring_position", position).withColumn(
        "ring_arc", arc_of("ring_position")
    )
    counted = placed.groupBy("ring_arc").count().collect()  # at most shards * points rows
    counts = {r["ring_arc"]: r["count"] for r in counted}
    room = capacities(sum(counts.values()), shards, slack)
    quotas = spark.createDataFrame(
        walk(counts, clockwise(owners, shards), room), QUOTAS
    ).join(
        spark.createDataFrame(list(enumerate(owners)), "ring_arc int, home_shard int"),
        "ring_arc",
    )
    order = Window.partitionBy("ring_arc").orderBy("ring_position", *(ties or []))
    ranked = placed.withColumn("ring_rank", F.row_number().over(order) - F.lit(1).cast("long"))
    return (
        ranked.join(F.broadcast(quotas), "ring_arc")
        .filter((F.col("ring_rank") >= F.col("first_rank")) & (F.col("ring_rank") < F.col("end_rank")))
        .withColumn("slot", F.col("first_slot") + F.col("ring_rank") - F.col("first_rank"))
        .select(*plain.columns, "home_shard", "shard", "slot")
    )


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``size`` (UTF-8 bytes of the text plus 16, a null text has none)
    and ``text_crc32``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def op4_ring_shards(spark, sf_dir: str) -> DataFrame:
    """Documents in 40 shards whose counts differ by at most one."""
    docs = measured(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    position = F.xxhash64("doc_id", "text_crc32", "size")
    placed = bounded_ring(docs, position, ties=["doc_id", "text_crc32", "size"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "home_shard",
    )
