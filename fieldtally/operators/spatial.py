"""Nearest neighbours of places: among points, or among the edges of polygons.

Space is divided into square cells whose widths are powers of four, the same for every
table. One aggregate tells how full the cells of each width are. A place begins with
the few widest cells in use and keeps, width by width, the cells that can still hold
its nearest neighbour; at the end it is compared with what lies in the cells that are
left. Places are reduced to distinct coordinates first and stay where they are: cells
come to them, broadcast where their counted number is small."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.functions.projection import planar_distance
from fieldtally.operators.polygons import (
    STEP,
    cell_index,
    cell_of,
    distinct_places,
    edge_cells,
    first_around,
    outside_whole_cells,
    place_key,
)
from fieldtally.sources.staging import stage

# Things in a cell that may be compared directly; a fuller cell is divided.
CELL_LIMIT = 64
# Cells (some 40 bytes each) and things that may be broadcast to all places.
BROADCAST_ROWS = 100_000
# Widths of cells as powers of STEP: from a millimetre to more than the earth.
FINEST, WIDEST = -5, 13
# Borders and distances are rounded numbers; the margin only ever keeps a cell.
MARGIN = 1e-6


@dataclass(frozen=True)
class _Pyramid:
    """Things by the cells of the finest ``level``, and how many cells of each width
    hold one. ``cells`` has ``cx, cy, known_x, known_y`` (a point known to be on the
    thing) and what is needed to measure its distance."""

    cells: DataFrame
    level: int
    used: dict[int, int]
    things: int

    @property
    def widest(self) -> int:
        """The finest width at which few cells are in use."""
        return min(k for k, n in self.used.items() if n <= STEP * STEP or k == WIDEST)

    def at(self, level: int) -> list[Column]:
        """Cell numbers at a level no finer than that of the cells."""
        shift = 2 * (level - self.level)
        return [F.shiftright(c, shift).alias(c) for c in ("cx", "cy")]

    def occupied(self, level: int) -> DataFrame:
        known = [F.any_value(c).alias(c) for c in ("known_x", "known_y")]
        return self.cells.select(*self.at(level), "known_x", "known_y").groupBy("cx", "cy").agg(*known)

    def children(self, level: int) -> DataFrame:
        """Cells of a level with their occupied parts, 16 at most."""
        inner = F.collect_list(F.struct("cx", "cy", "known_x", "known_y")).alias("children")
        outer = [F.shiftright(c, 2).alias(f"outer_{c}") for c in ("cx", "cy")]
        table = self.occupied(level - 1).groupBy(*outer).agg(inner)
        return F.broadcast(table) if self.used[level - 1] <= BROADCAST_ROWS else table


def nearest(
    left: DataFrame, right: DataFrame, right_id: str, max_distance: float | None = None
) -> DataFrame:
    """The nearest ``right`` point of each ``left`` point, by columns ``x`` and
    ``y``: adds ``nearest_id`` and ``distance``; both are null when nothing lies
    within ``max_distance``. Equal distances go to the smallest id. Building the plan
    runs one job, which counts cells."""
    points = (
        right.withColumn("__place", place_key(right))
        .groupBy("__place")
        .agg(F.any_value("x").alias("x"), F.any_value("y").alias("y"), F.min(right_id).alias("id"))
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    finest = points.select(
        *[cell_of(F.col(c), F.lit(FINEST)).alias(n) for c, n in (("x", "cx"), ("y", "cy"))],
        F.col("x").alias("known_x"),
        F.col("y").alias("known_y"),
        "id",
    )
    pyramid = _over_points(finest)
    if pyramid is None:
        no_id = F.lit(None).cast(right.schema[right_id].dataType)
        return left.withColumns({"distance": F.lit(None).cast("double"), "nearest_id": no_id})
    apart = planar_distance(F.col("x"), F.col("y"), F.col("known_x"), F.col("known_y"))
    placed = left.withColumn("__place", place_key(left))
    found = _search(distinct_places(placed), pyramid, apart, max_distance)
    return placed.join(found, "__place", "left").select(*left.columns, "distance", "nearest_id")


def nearest_region(places: DataFrame, edges: DataFrame) -> DataFrame:
    """The nearest polygon of each of ``places`` (columns ``x``, ``y``): adds
    ``nearest_id`` and ``distance``, which is zero inside and on the border. Equal
    distances go to the smallest id.

    Only places outside all polygons are compared with edges, and only with those parts
    of edges that other polygons leave bare: on the way to a point inside a polygon its
    border is met first. The edges, their cells and the places inside are written once."""
    edges = stage(edges, "edges")
    layer = edges.agg(
        F.sum(F.abs(F.col("x1") - F.col("x2")) + F.abs(F.col("y1") - F.col("y2"))).alias("length"),
        F.count("*").alias("edges"),
    ).first()
    if not layer.edges:
        no_id = F.lit(None).cast(edges.schema["poly_id"].dataType)
        return places.withColumns({"distance": F.lit(None).cast("double"), "nearest_id": no_id})
    index = stage(cell_index(edges, finer=1), "cells")
    # A quarter as wide as an edge is long, on average: then edges reach few cells each,
    # and the cells wholly inside polygons are as narrow.
    level = min(max(round(log(layer.length / layer.edges, STEP)) - 1, FINEST), WIDEST)
    reached = edge_cells(edges.withColumn("level", F.lit(level)))
    ends = ("x1", "y1", "x2", "y2")
    every = reached.select(
        F.explode(F.sequence("cx0", "cx1")).alias("cx"), "cy", *ends, F.col("poly_id").alias("id")
    )
    cells = stage(outside_whole_cells(every, level, index), "bare").withColumns(
        dict(zip(("known_x", "known_y"), _foot(
            *[(F.col(c) + F.lit(0.5)) * F.lit(STEP**level) for c in ("cx", "cy")]
        )))
    )
    pyramid = _counted(cells, level)
    placed = places.withColumn("__place", place_key(places))
    apart = planar_distance(F.col("x"), F.col("y"), *_foot(F.col("x"), F.col("y")))
    distinct = distinct_places(placed)
    within = stage(first_around(distinct, index), "around")
    near = _search(distinct.join(within, "__place", "left_anti"), pyramid, apart, None)
    found = within.select("__place", F.lit(0.0).alias("distance"), F.col("around").alias("nearest_id")).union(
        near.select("__place", "distance", "nearest_id")
    )
    return placed.join(found, "__place", "left").select(*places.columns, "distance", "nearest_id")


def _foot(x: Column, y: Column) -> tuple[Column, Column]:
    """The point of the edge ``x1, y1, x2, y2`` that is nearest to a point."""
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    share = ((x - F.col("x1")) * wide + (y - F.col("y1")) * high) / (wide * wide + high * high)
    share = F.greatest(F.least(share, F.lit(1.0)), F.lit(0.0))
    return F.col("x1") + share * wide, F.col("y1") + share * high


def _over_points(finest: DataFrame) -> _Pyramid | None:
    """Cells of points: the widest in which no more than ``CELL_LIMIT`` lie together."""
    fullest, used, things = _fill(finest, FINEST)
    if not things:
        return None
    level = max((k for k, n in fullest.items() if n <= CELL_LIMIT), default=FINEST)
    shift = 2 * (level - FINEST)
    cells = finest.withColumns({c: F.shiftright(c, shift) for c in ("cx", "cy")})
    return _Pyramid(cells, level, {k: n for k, n in used.items() if k >= level}, things)


def _counted(cells: DataFrame, level: int) -> _Pyramid:
    _, used, things = _fill(cells, level)
    return _Pyramid(cells, level, used, things)


def _fill(cells: DataFrame, finest: int) -> tuple[dict[int, int], dict[int, int], int]:
    """For each level: the things in its fullest cell and the number of cells in use;
    and the number of things. At most one row per level comes to the driver."""
    levels = F.array(*[
        F.struct(F.lit(k).alias("level"), *[F.shiftright(c, 2 * (k - finest)).alias(c) for c in ("cx", "cy")])
        for k in range(finest, WIDEST + 1)
    ])
    rows = (
        cells.select(F.explode(levels).alias("cell"))
        .groupBy("cell.level", "cell.cx", "cell.cy")
        .count()
        .groupBy("level")
        .agg(F.max("count").alias("most"), F.count("*").alias("cells"), F.sum("count").alias("things"))
        .collect()
    )
    return (
        {r["level"]: r["most"] for r in rows},
        {r["level"]: r["cells"] for r in rows},
        rows[0]["things"] if rows else 0,
    )


def _search(places: DataFrame, pyramid: _Pyramid, apart: Column, radius: float | None) -> DataFrame:
    """``__place, distance, nearest_id`` of the distinct ``places``. ``reach`` is how far
    away the nearest thing can be at most."""
    if radius is None:
        start = pyramid.widest
        frontier = _from_widest(places, pyramid, start)
    else:
        # Slightly wide, so that rounding cannot push a match out of reach.
        wide = ceil(log(max(radius * (1 + 1e-9), 1e-3), STEP))
        start = min(max(wide, pyramid.level), WIDEST)
        around = _neighbours(*[cell_of(F.col(c), F.lit(start)) for c in ("x", "y")])
        frontier = places.select(
            "__place", "x", "y", F.lit(float(radius)).alias("reach"), F.explode(around).alias("cell")
        ).select("__place", "x", "y", "reach", "cell.*")
    for level in range(start, pyramid.level, -1):
        frontier = _narrow(frontier, pyramid.children(level), level - 1)
    cells = pyramid.cells
    if pyramid.things <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    measured = frontier.join(cells, ["cx", "cy"]).withColumn("distance", apart)
    if radius is not None:
        measured = measured.filter(F.col("distance") <= radius)
    return (
        measured.filter(F.col("distance") <= F.col("reach") + F.lit(MARGIN))
        .groupBy("__place")
        .agg(F.min(F.struct("distance", "id")).alias("best"))
        .select("__place", "best.distance", F.col("best.id").alias("nearest_id"))
    )


def _from_widest(places: DataFrame, pyramid: _Pyramid, level: int) -> DataFrame:
    """First candidates where there is no radius: the widest cells, few enough to come
    as one value from a subquery."""
    few = pyramid.occupied(level).agg(
        F.collect_list(F.struct("cx", "cy", "known_x", "known_y")).alias("cells")
    )
    opened = places.withColumn("cell", F.explode(few.scalar())).select("__place", "x", "y", "cell.*")
    return _kept(opened.withColumn("reach", F.lit(float("inf"))), level)


def _narrow(frontier: DataFrame, children: DataFrame, level: int) -> DataFrame:
    """Replace candidate cells by their parts."""
    same = [F.col("cx") == F.col("outer_cx"), F.col("cy") == F.col("outer_cy")]
    opened = (
        frontier.join(children, same)
        .select("__place", "x", "y", "reach", F.explode("children").alias("child"))
        .select("__place", "x", "y", "reach", "child.*")
    )
    return _kept(opened, level)


def _kept(opened: DataFrame, level: int) -> DataFrame:
    """Candidate cells that can hold the nearest thing: a cell is out when it starts
    farther away than a point that is known in some other cell."""
    near = F.col("start") <= F.col("reach") + F.lit(MARGIN)
    known = planar_distance(F.col("x"), F.col("y"), F.col("known_x"), F.col("known_y"))
    shortest = F.min("known").over(Window.partitionBy("__place"))
    return (
        opened.withColumns({"known": known, "start": _starts_at(level)})
        .filter(near)
        .withColumn("reach", F.least("reach", shortest))
        .filter(near)
        .select("__place", "x", "y", "reach", "cx", "cy")
    )


def _starts_at(level: int) -> Column:
    """Distance from a place to the nearest border of its candidate cell. Widths are
    powers of two, so borders are exact."""
    width = F.lit(STEP**level)
    gaps = []
    for value, cell in (("x", "cx"), ("y", "cy")):
        low = F.col(cell) * width
        gaps.append(F.greatest(low - F.col(value), F.col(value) - low - width, F.lit(0.0)))
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1])


def _neighbours(cx: Column, cy: Column) -> Column:
    return F.array(*[
        F.struct((cx + F.lit(i)).alias("cx"), (cy + F.lit(j)).alias("cy"))
        for i in (-1, 0, 1)
        for j in (-1, 0, 1)
    ])
