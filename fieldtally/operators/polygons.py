"""Polygon layers: which points lie in them.

A layer of any size is tested by one equi-join on grid cells. Every polygon has cells
of its own size, chosen from its extent, its number of edges and their length, so that
its edges reach about as many cells as there are edges. A cell knows whether its
reference point is inside the polygon and which edges pass through it; a point is inside
if the straight way to the reference point crosses an odd number of those edges, or an
even one, as the reference point says. Edges elsewhere are never looked at."""

from __future__ import annotations

from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.operators.lookups import left_lookup
from fieldtally.sources.staging import stage, tidy, unstage

# Cells are powers of this wide, so that polygons of similar size share a grid.
STEP = 4.0
# Where a cell has its reference point, in cell widths. Corners of polygons are hardly
# ever there.
REFERENCE = (sqrt(2.0) - 1.0, sqrt(3.0) - 1.0)
# Rounding must not lose a cell at an edge's rim: parts of a cell and of a coordinate.
RIM = (1e-9, 1e-12)
# Rings of up to so many points are each closed by one task.
RING_POINTS = 100_000
# A larger layer is tested in parts of about so many edges, one after the other.
PART_EDGES = 20_000_000
# Cells (some 40 bytes each) that may be broadcast.
BROADCAST_CELLS = 100_000


def ring_edges(rings: DataFrame) -> DataFrame:
    """Edges of polygon rings given as ``poly_id, ring_id, seq, x, y`` with
    consecutive ``seq``. A ring may repeat its first point at the end or not.
    Building the plan runs one job, which looks how far apart numbers are at most: rings
    that can only be short are sorted, so every point is shuffled once. Otherwise points
    meet their successors in an equi-join, so a ring of any length is spread over all
    tasks."""
    span = rings.agg(F.max("seq") - F.min("seq")).first()[0]
    short = span is None or span < RING_POINTS
    linked = _sorted_points(rings) if short else _joined_points(rings)
    return linked.select(
        "poly_id",
        F.col("x").alias("x1"),
        F.col("y").alias("y1"),
        F.col("target.x").alias("x2"),
        F.col("target.y").alias("y2"),
    ).filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def _no_successor() -> Column:
    return F.raise_error(F.lit("ring points are not numbered consecutively"))


def _sorted_points(rings: DataFrame) -> DataFrame:
    """Points with their ``target``, in rows of their own where a number repeats."""
    along = Window.partitionBy("poly_id", "ring_id").orderBy("seq")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    point = F.struct("x", "y")
    following = F.col("following")
    targets = F.when(F.col("seq") == F.col("last_seq"), F.array("opening")).otherwise(
        F.when(F.size(following) > 0, following).otherwise(
            _no_successor().cast("array<struct<x:double,y:double>>")
        )
    )
    return rings.withColumns({
        "following": F.collect_list(point).over(along.rangeBetween(1, 1)),
        "last_seq": F.max("seq").over(whole),
        "opening": F.min_by(point, "seq").over(whole),
    }).select("poly_id", "x", "y", F.explode(targets).alias("target"))


def _joined_points(rings: DataFrame) -> DataFrame:
    ring = ["poly_id", "ring_id"]
    following = rings.select(
        *ring, (F.col("seq") - 1).alias("seq"), F.struct("x", "y").alias("following")
    )
    ends = rings.groupBy(*ring).agg(
        F.max("seq").alias("last_seq"), F.min_by(F.struct("x", "y"), "seq").alias("opening")
    )
    linked = left_lookup(left_lookup(rings, following, [*ring, "seq"]), ends, ring)
    target = F.when(F.col("seq") == F.col("last_seq"), F.col("opening")).otherwise(
        F.coalesce("following", _no_successor().cast("struct<x:double,y:double>"))
    )
    return linked.select("poly_id", "x", "y", target.alias("target"))


def cell_width(level: Column) -> Column:
    return F.pow(F.lit(STEP), level.cast("double"))


def cell_of(value: Column, level: Column) -> Column:
    return F.floor(value / cell_width(level)).cast("long")


def polygon_levels(edges: DataFrame) -> DataFrame:
    """``poly_id, level``: cells so wide that neither the polygon's box nor its edges
    reach many more cells than it has edges."""
    return polygon_boxes(edges).select("poly_id", "level")


def polygon_boxes(edges: DataFrame) -> DataFrame:
    """The levels of polygons with their boxes ``x0, y0, x1, y1``, which reach few cells
    of their own ``box_level``."""
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    width = F.greatest(F.sqrt(wide * high / F.col("edges")), F.col("length") / F.col("edges"))
    length = F.sum(F.abs(F.col("x1") - F.col("x2")) + F.abs(F.col("y1") - F.col("y2")))
    sums = edges.groupBy("poly_id").agg(
        F.min(F.least("x1", "x2")).alias("x0"),
        F.min(F.least("y1", "y2")).alias("y0"),
        F.max(F.greatest("x1", "x2")).alias("x1"),
        F.max(F.greatest("y1", "y2")).alias("y1"),
        length.alias("length"),
        F.count("*").alias("edges"),
    )
    return sums.select(
        "poly_id",
        F.round(F.log(STEP, width)).cast("int").alias("level"),
        F.ceil(F.log(STEP, F.greatest(wide, high))).cast("int").alias("box_level"),
        "x0", "y0", "x1", "y1",
    )


def edge_cells(edges: DataFrame) -> DataFrame:
    """A row for every row ``cy`` of cells that an edge (with its ``level``) reaches, and
    the first and last cell ``cx0, cx1`` it reaches there."""
    width = cell_width(F.col("level"))
    size = F.greatest(*[F.abs(F.col(c)) for c in ("x1", "y1", "x2", "y2")])
    rim = width * RIM[0] + size * RIM[1]

    def cell(value: Column) -> Column:
        return F.floor(value / F.col("width")).cast("long")

    def at(y: Column) -> Column:
        share = F.greatest(F.least((y - F.col("y1")) / (F.col("y2") - F.col("y1")), F.lit(1.0)), F.lit(0.0))
        return F.col("x1") + share * (F.col("x2") - F.col("x1"))

    low = F.col("cy") * F.col("width") - F.col("rim")
    high = (F.col("cy") + 1) * F.col("width") + F.col("rim")
    level_edge = F.col("y1") == F.col("y2")
    ends = [
        F.when(level_edge, F.col(c)).otherwise(at(y)) for c, y in (("x1", low), ("x2", high))
    ]
    rows = F.sequence(
        cell(F.least("y1", "y2") - F.col("rim")), cell(F.greatest("y1", "y2") + F.col("rim"))
    )
    return (
        edges.withColumns({"width": width, "rim": rim})
        .withColumn("cy", F.explode(rows))
        .withColumns({"xa": ends[0], "xb": ends[1]})
        .withColumns({
            "cx0": cell(F.least("xa", "xb") - F.col("rim")),
            "cx1": cell(F.greatest("xa", "xb") + F.col("rim")),
        })
        .drop("xa", "xb", "rim")
    )


def cell_index(edges: DataFrame, finer: int = 0, levels: DataFrame | None = None) -> DataFrame:
    """Cells of polygons: ``poly_id, level, cy, cx, odd, edges``. ``odd`` tells whether the
    reference point is inside; cells wholly inside have no edges, cells wholly outside
    are not listed. ``finer`` levels below those of ``polygon_levels``, or polygons with
    their ``levels``, where not all are wanted. One shuffle brings the rows of cells
    together, for their cells' edges and for the sum along the row."""
    if levels is None:
        levels = polygon_levels(edges).withColumn("level", F.col("level") - finer)
        levelled = left_lookup(edges, levels, ["poly_id"])
    else:
        own = levels.withColumnRenamed("poly_id", "__poly_id")
        same = F.col("poly_id").eqNullSafe(F.col("__poly_id"))
        levelled = edges.join(own, same).drop("__poly_id")
    reached = edge_cells(levelled).repartition("poly_id", "level", "cy")
    reference = (F.col("cy") + F.lit(REFERENCE[1])) * F.col("width")
    passes = (F.col("y1") > reference) != (F.col("y2") > reference)
    crossing = F.col("x1") + (reference - F.col("y1")) * (F.col("x2") - F.col("x1")) / F.nullif(
        F.col("y2") - F.col("y1"), F.lit(0.0)
    )
    # The first cell whose reference point has the crossing to its left.
    first = F.floor(crossing / F.col("width") - F.lit(REFERENCE[0])).cast("long") + 1
    edge = F.struct("x1", "y1", "x2", "y2")
    touched = F.transform(
        F.sequence("cx0", "cx1"),
        lambda cx: F.struct(cx.alias("cx"), F.lit(0).alias("turns"), edge.alias("edge")),
    )
    turned = F.array(
        F.struct(
            first.alias("cx"), F.lit(1).alias("turns"),
            F.when(F.lit(False), edge).alias("edge"),
        )
    )
    row = ["poly_id", "level", "cy"]
    cells = (
        reached.select(*row, F.explode(F.when(passes, F.concat(touched, turned)).otherwise(touched)).alias("cell"))
        .select(*row, "cell.*")
        .groupBy(*row, "cx")
        .agg(F.sum("turns").alias("turns"), F.collect_list("edge").alias("edges"))
    )
    along = Window.partitionBy(*row).orderBy("cx")
    odd = F.sum("turns").over(along.rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    listed = cells.withColumns({"odd": odd, "next": F.lead("cx").over(along)}).filter(
        F.col("odd") | (F.size("edges") > 0)
    )
    last = F.when(F.col("odd"), F.coalesce(F.col("next") - 1, "cx")).otherwise(F.col("cx"))
    run = listed.withColumn("at", F.explode(F.sequence("cx", last)))
    own = F.when(F.col("at") == F.col("cx"), F.col("edges")).otherwise(F.slice("edges", 1, 0))
    return run.select(*row, F.col("at").alias("cx"), "odd", own.alias("edges"))


def inside(points: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of ``points`` (columns ``x``, ``y``) inside or on the border of any polygon
    of the edge table; holes are rings too. Rows are never repeated.

    Where all polygons share one cell size, the test is the condition of a semi join and
    the points are not touched otherwise. Where they do not, each distinct place is
    looked up once per size. Either way a place is tested until the first polygon that
    covers it, however many do: the more polygons lie over each other, the earlier that
    one is met. The edges are written once.

    Layers of more than PART_EDGES edges are tested part by part, so that the cells of one
    part are on disk at a time. A part meets the places that no earlier part covers, and
    only those of its polygons with such a place near their box."""
    with tidy(points.sparkSession):
        edges = stage(edges, "edges")
        found = polygon_boxes(edges).select("level", "box_level").distinct().collect()
    levels = sorted({r["level"] for r in found})
    if not levels:
        return points.limit(0)
    parts = -(-edges.count() // PART_EDGES)
    if parts > 1:
        return _inside_by_parts(points, edges, parts, levels, sorted({r["box_level"] for r in found}))
    index = _renamed(cell_index(edges))
    if len(levels) == 1:
        keyed = points.withColumns(_keys(points, F.lit(levels[0])))
        same = [F.col(f"__point_{c}") == F.col(f"__{c}") for c in ("cx", "cy")]
        kept = keyed.join(index, [*same, _covers()], "left_semi")
        return kept.select(*points.columns)
    placed = points.withColumn("__place", place_key(points))
    asked = _asked(distinct_places(placed), levels)
    covered = asked.join(index, _met(), "left_semi").select("__place").distinct()
    return placed.join(covered, "__place", "left_semi").drop("__place")


def _inside_by_parts(
    points: DataFrame, edges: DataFrame, parts: int, levels: list[int], box_levels: list[int]
) -> DataFrame:
    """``inside`` for a written layer, which is divided and in the end deleted."""
    spark = points.sparkSession
    placed = points.withColumn("__place", place_key(points))
    own = F.pmod(F.xxhash64("poly_id"), F.lit(parts)).cast("int")
    covered = []
    with tidy(spark):
        divided = stage(edges.withColumn("__part", own), "parts", by="__part")
        unstage(spark, edges)
        bare = stage(distinct_places(placed), "bare")
        for part in range(parts):
            of_part = divided.filter(F.col("__part") == part).drop("__part")
            occupied = stage(_occupied(bare, box_levels), "occupied")
            near = _near(polygon_boxes(of_part), occupied)
            index = _renamed(cell_index(of_part, levels=near))
            met = _asked(bare, levels).join(index, _met(), "left_semi")
            covered.append(stage(met.select("__place").distinct(), "covered"))
            rest = stage(bare.join(covered[-1], "__place", "left_anti"), "bare")
            unstage(spark, bare, occupied)
            bare = rest
            if not bare.count():
                break
        unstage(spark, bare, divided)
    return placed.join(reduce(DataFrame.union, covered), "__place", "left_semi").drop("__place")


def _occupied(places: DataFrame, levels: list[int]) -> DataFrame:
    """The cells of each level that hold a place."""
    return _asked(places, levels).select(
        F.col("__asked").alias("box_level"),
        F.col("__point_cx").alias("cx"),
        F.col("__point_cy").alias("cy"),
    ).distinct()


def _near(boxes: DataFrame, occupied: DataFrame) -> DataFrame:
    """``poly_id, level`` of the polygons whose box reaches an occupied cell."""
    few = F.broadcast(occupied) if occupied.count() <= BROADCAST_CELLS else occupied
    level = F.col("box_level")
    size = F.greatest(*[F.abs(F.col(c)) for c in ("x0", "y0", "x1", "y1")])
    rim = cell_width(level) * RIM[0] + size * RIM[1]
    reach = [
        F.sequence(cell_of(F.col(f"{c}0") - rim, level), cell_of(F.col(f"{c}1") + rim, level))
        for c in ("x", "y")
    ]
    reached = (
        boxes.select("poly_id", "level", "box_level", F.explode(reach[0]).alias("cx"), reach[1].alias("rows"))
        .select("poly_id", "level", "box_level", "cx", F.explode("rows").alias("cy"))
    )
    return reached.join(few, ["box_level", "cx", "cy"], "left_semi").select("poly_id", "level").distinct()


def first_around(places: DataFrame, index: DataFrame) -> DataFrame:
    """``__place, around``: the smallest polygon around, or bordering on, each of the
    distinct ``places`` (``__place, x, y``) that has one. In a cell that lies wholly
    inside a polygon of the ``index``, only smaller ones are tested: with cells narrow
    enough for polygons to have such cells, a place meets few polygons however many lie
    over each other."""
    levels = [r["level"] for r in index.select("level").distinct().collect()]
    cell = Window.partitionBy("level", "cx", "cy")
    least = F.min(F.when(F.size("edges") == 0, F.col("poly_id"))).over(cell)
    needed = index.withColumn("least", least).filter(F.col("poly_id") <= F.coalesce("least", "poly_id"))
    found = _asked(places, levels or [0]).join(_renamed(needed), _met())
    return found.groupBy("__place").agg(F.min("__poly_id").alias("around"))


def outside_whole_cells(cells: DataFrame, level: int, index: DataFrame) -> DataFrame:
    """Those of the ``cells`` (``cx``, ``cy`` of a ``level``) that do not lie in a cell of
    the ``index`` that is wholly inside a polygon."""
    whole = index.filter(F.size("edges") == 0).select("level", "cx", "cy").distinct()
    for wide in sorted(r["level"] for r in whole.select("level").distinct().collect()):
        if wide >= level:
            same = [F.shiftright(cells[c], 2 * (wide - level)) == F.col(f"whole_{c}") for c in ("cx", "cy")]
            of_level = whole.filter(F.col("level") == wide).select(
                F.col("cx").alias("whole_cx"), F.col("cy").alias("whole_cy")
            )
            cells = cells.join(of_level, same, "left_anti")
    return cells


def _asked(places: DataFrame, levels: list[int]) -> DataFrame:
    """The places with their cells of each level."""
    asked = places.withColumn("__asked", F.explode(F.array(*[F.lit(level) for level in sorted(levels)])))
    return asked.withColumns(_keys(places, F.col("__asked")))


def _met() -> list[Column]:
    same = [F.col(f"__point_{c}") == F.col(f"__{c}") for c in ("cx", "cy")]
    return [F.col("__asked") == F.col("__level"), *same, _covers()]


def _renamed(index: DataFrame) -> DataFrame:
    return index.withColumnsRenamed({c: f"__{c}" for c in index.columns})


def _keys(points: DataFrame, level: Column) -> dict[str, Column]:
    """The cell of a point. A point without coordinates gets a number of its own in
    place of a null: the null filter of a join would move below the projection of the
    coordinates and repeat its long arithmetic, and nulls would meet in one task."""
    own = F.xxhash64(*[F.col(f"`{c}`") for c in points.columns])
    return {
        "__point_cx": F.coalesce(cell_of(F.col("x"), level), own),
        "__point_cy": F.coalesce(cell_of(F.col("y"), level), own),
    }


def place_text() -> Column:
    """A place as exact text, null without coordinates. Keyed by doubles, every grouping
    would shuffle anew, because those keys are normalised first."""
    both = F.concat_ws(",", *[(F.col(c) + F.lit(0.0)).cast("string") for c in ("x", "y")])
    return F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), both)


def place_key(points: DataFrame) -> Column:
    """``place_text``, or else a text that spreads rows without a place over all tasks."""
    own = F.xxhash64(*[F.col(f"`{c}`") for c in points.columns])
    return F.coalesce(place_text(), F.concat(F.lit("none "), own.cast("string")))


def distinct_places(placed: DataFrame) -> DataFrame:
    """The distinct places with coordinates. These are aggregates, not keys: filters on
    keys would move below the projection and repeat its long arithmetic."""
    return (
        placed.groupBy("__place")
        .agg(F.any_value("x").alias("x"), F.any_value("y").alias("y"))
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    )


def _covers() -> Column:
    """The point is inside the polygon of a cell, or on its border."""
    level = F.col("__level")
    x0, y0 = (
        (F.col(c) + F.lit(r)) * cell_width(level) for c, r in zip(("__cx", "__cy"), REFERENCE)
    )
    x, y = F.col("x"), F.col("y")

    def crosses(e: Column) -> Column:
        ends = _turn(x0, y0, x, y, e["x1"], e["y1"]) != _turn(x0, y0, x, y, e["x2"], e["y2"])
        points = [(x0, y0), (x, y)]
        sides = [_turn(e["x1"], e["y1"], e["x2"], e["y2"], *p) for p in points]
        return ends & (sides[0] != sides[1])

    def touches(e: Column) -> Column:
        cross = (x - e["x1"]) * (e["y2"] - e["y1"]) - (y - e["y1"]) * (e["x2"] - e["x1"])
        box = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"])) & y.between(
            F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
        )
        return (cross == 0) & box

    odd = F.size(F.filter("__edges", crosses)) % 2 == 1
    return F.coalesce((odd != F.col("__odd")) | F.exists("__edges", touches), F.lit(False))


def _turn(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column) -> Column:
    """The third point is to the left of the way from the first to the second."""
    return (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) > 0
