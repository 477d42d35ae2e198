from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from fieldtally.operators import polygons, spatial
from fieldtally.operators.polygons import cell_index, inside, polygon_levels, ring_edges
from fieldtally.operators.spatial import nearest, nearest_region
from fieldtally.sources.staging import stage, tidy


def brute(left, right, radius):
    found = {}
    for a, x, y in left:
        if x is None or y is None:
            found[a] = None
            continue
        best = min((((x - u) ** 2 + (y - v) ** 2) ** 0.5, b) for b, u, v in right)
        found[a] = best if radius is None or best[0] <= radius else None
    return found


def clustered(seed, count, label):
    """A third of the points within centimetres, the rest spread out."""
    rng = random.Random(seed)
    points = []
    for i in range(count):
        if i % 3 == 0:
            x, y = 5000 + rng.random() * 0.05, 7000 + rng.random() * 0.05
        else:
            x, y = rng.random() * 20000, rng.random() * 15000
        points.append((f"{label}{i:04d}", x, y))
    return points


@pytest.mark.parametrize("radius", [None, 300.0, 5000.0])
@pytest.mark.parametrize("limit", [64, 3])
def test_nearest_equals_brute_force(frame, monkeypatch, radius, limit):
    monkeypatch.setattr(spatial, "CELL_LIMIT", limit)
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 1000 if limit == 3 else 100_000)
    left = clustered(1, 240, "a") + [("none", None, 1.0), ("twin", 1.0, 2.0), ("twin2", 1.0, 2.0)]
    right = clustered(2, 300, "b") + [("zz", 1.0, 2.5), ("yy", 1.0, 2.5)]
    found = nearest(
        frame("id string, x double, y double", *left),
        frame("name string, x double, y double", *right),
        "name",
        radius,
    ).collect()
    assert len(found) == len(left)
    expected = brute(left, right, radius)
    for row in found:
        if expected[row.id] is None:
            assert (row.distance, row.nearest_id) == (None, None)
        else:
            assert row.distance == pytest.approx(expected[row.id][0], abs=1e-9)
            assert row.nearest_id == expected[row.id][1]


def test_radius_is_inclusive(frame, tuples):
    left = frame("id int, x double, y double", (1, 0.0, 0.0), (2, 0.0, 1.0), (3, 0.0, -1.0))
    right = frame("k int, x double, y double", (9, 1000.0, 0.0))
    found = nearest(left.withColumn("y", F.lit(0.0)).withColumn("x", 2.0 - F.col("id")), right, "k", 1000.0)
    assert tuples(found, "id", "nearest_id") == [(1, 9), (2, 9), (3, None)]


def test_nothing_to_find(frame, tuples):
    left = frame("id int, x double, y double", (1, 0.0, 0.0))
    right = frame("k string, x double, y double", ("a", None, 0.0))
    assert tuples(nearest(left, right, "k"), "id", "distance", "nearest_id") == [(1, None, None)]


def test_single_point(frame, tuples):
    left = frame("id int, x double, y double", (1, 3.0, 4.0))
    right = frame("k string, x double, y double", ("a", 0.0, 0.0))
    assert tuples(nearest(left, right, "k"), "distance", "nearest_id") == [(5.0, "a")]


RINGS = [
    # A square with a square hole.
    *[(1, 0, i, x, y) for i, (x, y) in enumerate([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)])],
    *[(1, 1, i, x, y) for i, (x, y) in enumerate([(4, 4), (6, 4), (6, 6), (4, 6)])],
    # A triangle that overlaps it.
    *[(2, 0, i, x, y) for i, (x, y) in enumerate([(8, 8), (20, 8), (8, 20)])],
]


def inside_by_hand(x, y):
    rings = {}
    for poly, ring, _, u, v in RINGS:
        rings.setdefault((poly, ring), []).append((u, v))
    for poly in (1, 2):
        odd = False
        for (p, _), points in rings.items():
            if p != poly:
                continue
            for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
                cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
                if (
                    cross == 0
                    and (x1, y1) != (x2, y2)
                    and min(x1, x2) <= x <= max(x1, x2)
                    and min(y1, y2) <= y <= max(y1, y2)
                ):
                    return True
                if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                    odd = not odd
        if odd:
            return True
    return False


def test_inside_equals_ray_casting(frame):
    rng = random.Random(3)
    points = [(i, rng.random() * 24 - 2, rng.random() * 24 - 2) for i in range(600)]
    points += [(1000 + i, float(x), float(y)) for i, (_, _, _, x, y) in enumerate(RINGS)]
    points += [(2000, 5.0, 4.0), (2001, 5.0, 5.0), (2002, 9.0, 9.0), (2003, 9.0, 9.0)]
    rings = frame(
        "poly_id int, ring_id int, seq int, x double, y double",
        *[(p, r, s, float(x), float(y)) for p, r, s, x, y in RINGS],
    )
    table = frame("id int, x double, y double", *points, (3000, None, 1.0))
    found = sorted(r.id for r in inside(table, ring_edges(rings)).collect())
    assert found == sorted(i for i, x, y in points if inside_by_hand(x, y))


def star(rng, cx, cy, radius, corners):
    """A polygon with uneven teeth, turning either way."""
    turns = sorted(rng.random() * 2 * math.pi for _ in range(corners))
    ring = [
        (cx + math.cos(t) * radius * rng.uniform(0.3, 1), cy + math.sin(t) * radius * rng.uniform(0.3, 1))
        for t in turns
    ]
    return ring if rng.random() < 0.5 else ring[::-1]


def edge_rows(rings):
    return [
        (p, *map(float, (*a, *b))) for p, ring in rings for a, b in zip(ring, ring[1:] + ring[:1])
    ]


EDGES = "poly_id int, x1 double, y1 double, x2 double, y2 double"


def covering(edges, x, y):
    odd = {}
    for p, x1, y1, x2, y2 in edges:
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd[p] = not odd.get(p, False)
    return {p for p, o in odd.items() if o}


@pytest.mark.parametrize("sizes", [[(500, 9)], [(2000, 300), (30, 5), (1, 4), (300, 40)]])
def test_inside_polygons_of_many_sizes(frame, sizes):
    rng = random.Random(17)
    rings = [
        (100 * k + i, star(rng, 4e6 + rng.random() * 3000, rng.random() * 3000 - 1500, radius, corners))
        for k, (radius, corners) in enumerate(sizes)
        for i in range(25)
    ]
    edges = edge_rows(rings)
    points = [(i, 4e6 + rng.random() * 3000, rng.random() * 3000 - 1500) for i in range(1500)]
    points += [(5000 + i, x + rng.random(), y + rng.random()) for i, (_, ring) in enumerate(rings) for x, y in ring[:2]]
    table, layer = frame("id int, x double, y double", *points), frame(EDGES, *edges)
    expected = sorted(i for i, x, y in points if covering(edges, x, y))
    assert 50 < len(expected) < len(points)
    assert sorted(r.id for r in inside(table, layer).collect()) == expected
    levels = polygon_levels(layer).select("level").distinct().count()
    assert levels > 1 or len(sizes) == 1


def test_places_are_tested_until_one_polygon_covers_them(frame):
    rings = [(k, star(random.Random(k), 0.0, 0.0, 10.0 ** (1 + k % 2), 6)) for k in range(20)]
    found = inside(frame("id int, x double, y double", (1, 0.0, 0.0)), frame(EDGES, *edge_rows(rings)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan.split("__asked", 1)[0] and plan.count("Join LeftSemi") == 2


def stages(monkeypatch):
    """The tables that polygons stage from now on, by name and number of rows."""
    written = []

    def counted(table, name, **how):
        found = stage(table, name, **how)
        written.append((name, found.count()))
        return found

    monkeypatch.setattr(polygons, "stage", counted)
    return written


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_large_layers_are_tested_in_parts(frame, monkeypatch, broadcast):
    rng = random.Random(29)
    rings = [
        (k if k else None, star(rng, 4e6 + rng.random() * 3000, rng.random() * 3000 - 1500, radius, corners))
        for k, (radius, corners) in enumerate([(900, 60), (30, 5), (1, 4), (300, 40)] * 15)
    ]
    edges = edge_rows(rings)
    points = [(i, 4e6 + rng.random() * 3000, rng.random() * 3000 - 1500) for i in range(1500)]
    points += [(5000 + i, x + rng.random(), y + rng.random()) for i, (_, ring) in enumerate(rings) for x, y in ring[:2]]
    table = frame("id int, x double, y double", *points, *points[:9], (9000, None, 1.0))
    expected = sorted(i for i, x, y in points + points[:9] if covering(edges, x, y))
    monkeypatch.setattr(polygons, "PART_EDGES", 400)
    monkeypatch.setattr(polygons, "BROADCAST_CELLS", broadcast)
    written = stages(monkeypatch)
    found = inside(table, frame(EDGES, *edges))
    assert 50 < len(expected) < len(points)
    assert sorted(r.id for r in found.collect()) == expected
    bare = [n for name, n in written if name == "bare"]
    covered = [n for name, n in written if name == "covered"]
    assert len(covered) == -(-len(edges) // 400) and bare == sorted(bare, reverse=True)
    assert [a - b for a, b in zip(bare, bare[1:])] == covered


def test_parts_end_when_all_places_are_covered(frame, monkeypatch, tuples):
    square = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    monkeypatch.setattr(polygons, "PART_EDGES", 4)
    written = stages(monkeypatch)
    layer = frame(EDGES, *edge_rows([(k, square) for k in range(9)]))
    table = frame("id int, x double, y double", (1, 0.0, 0.0), (2, 0.5, 1.0))
    assert tuples(inside(table, layer), "id") == [(1,), (2,)]
    assert [n for name, n in written if name == "covered"][-1] == 2


def test_only_polygons_near_places_get_cells(frame, monkeypatch):
    rings = [(k, [(10 * k, 0), (10 * k + 8, 0), (10 * k + 8, 8), (10 * k, 8)]) for k in range(200)]
    layer = frame(EDGES, *edge_rows(rings))
    places = frame("__place string, x double, y double", ("a", 4.0, 4.0), ("b", 1204.0, 4.0))
    boxes = polygons.polygon_boxes(layer)
    level = boxes.first().box_level
    near = polygons._near(boxes, polygons._occupied(places, [level]))
    found = {r.poly_id for r in near.collect()}
    assert {0, 120} <= found and len(found) < 12


def pairs(frame, side):
    """Edges that points meet, and rows of the index, for a grid of squares."""
    rings = [
        (i * side + j, [(i * 10, j * 10), (i * 10 + 8, j * 10), (i * 10 + 8, j * 10 + 8), (i * 10, j * 10 + 8)])
        for i in range(side)
        for j in range(side)
    ]
    rng = random.Random(side)
    points = [(i, rng.random() * side * 10, rng.random() * side * 10) for i in range(side * side)]
    index = cell_index(frame(EDGES, *edge_rows(rings)))
    (level,) = {r.level for r in index.select("level").distinct().collect()}
    where = [F.floor(F.col(c) / 4.0**level).alias(n) for c, n in (("x", "cx"), ("y", "cy"))]
    met = frame("id int, x double, y double", *points).select(*where).join(index, ["cx", "cy"])
    return met.agg(F.sum(F.size("edges"))).first()[0], index.count()


def test_pairs_grow_with_points_and_edges_only(frame):
    small, large = pairs(frame, 20), pairs(frame, 40)
    assert large[0] < 4.6 * small[0] and large[1] < 4.6 * small[1]
    assert large[0] < 20 * 40 * 40 and large[1] < 20 * 40 * 40


@pytest.mark.parametrize("limit", [100_000, 10])
def test_nearest_region_equals_brute_force(frame, monkeypatch, limit):
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", limit)
    rng = random.Random(23)
    rings = [(i, star(rng, rng.random() * 5000, rng.random() * 5000, rng.choice([20, 400]), 7)) for i in range(40)]
    edges = edge_rows(rings)
    points = [(i, rng.random() * 9000 - 2000, rng.random() * 9000 - 2000) for i in range(250)]
    found = nearest_region(
        frame("id int, x double, y double", *points, (999, None, 2.0)), frame(EDGES, *edges)
    ).collect()

    def apart(x, y, x1, y1, x2, y2):
        w, h = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((x - x1) * w + (y - y1) * h) / (w * w + h * h)))
        return math.hypot(x - x1 - t * w, y - y1 - t * h)

    assert len(found) == 251 and {c for c in found[0].asDict()} == {"id", "x", "y", "distance", "nearest_id"}
    where = {i: (x, y) for i, x, y in points}
    for row in found:
        if row.id == 999:
            assert (row.distance, row.nearest_id) == (None, None)
            continue
        around = covering(edges, *where[row.id])
        if around:
            assert (row.distance, row.nearest_id) == (0.0, min(around))
        else:
            best = min((apart(*where[row.id], *e[1:]), e[0]) for e in edges)
            assert row.distance == pytest.approx(best[0], abs=1e-6) and row.nearest_id == best[1]


def test_only_places_outside_meet_edges_of_the_rim(frame, monkeypatch):
    rng = random.Random(31)
    rings = [
        (i, [(x - 90, y - 90), (x + 90, y - 90), (x + 90, y + 90), (x - 90, y + 90)])
        for i, (x, y) in enumerate((rng.random() * 400, rng.random() * 400) for _ in range(200))
    ]
    inner = [(i, 50 + rng.random() * 300, 50 + rng.random() * 300) for i in range(60)]
    outer = [(100 + i, 600 + rng.random() * 300, rng.random() * 300) for i in range(40)]
    met, plain = [], spatial._search
    monkeypatch.setattr(spatial, "_search", lambda *given: met.append(given) or plain(*given))
    edges = frame(EDGES, *edge_rows(rings))
    found = nearest_region(frame("id int, x double, y double", *inner, *outer), edges)
    assert {r.id for r in found.filter("distance = 0").collect()} == {i for i, _, _ in inner}
    ((places, pyramid, *_),) = met
    assert places.count() == 40
    assert pyramid.cells.select("id", "x1", "y1").distinct().count() < 0.7 * edges.count()


def test_nearest_region_of_an_empty_layer(frame, tuples):
    found = nearest_region(frame("id int, x double, y double", (1, 0.0, 0.0)), frame(EDGES))
    assert tuples(found, "id", "distance", "nearest_id") == [(1, None, None)]


def test_plan_of_nearest_runs_one_job(frame, monkeypatch):
    left = frame("id int, x double, y double", *[(i, float(i), 0.0) for i in range(50)], (90, None, None))
    right = frame("k int, x double, y double", *[(i, i * 3.0, i % 7.0) for i in range(900)])
    actions = []
    plain = type(left).collect
    monkeypatch.setattr(type(left), "collect", lambda table: actions.append(table) or plain(table))
    found = nearest(left, right, "k")
    assert len(actions) == 1
    assert found.count() == 51


def test_ring_must_be_numbered(frame):
    rings = frame(
        "poly_id int, ring_id int, seq int, x double, y double",
        (1, 0, 0, 0.0, 0.0), (1, 0, 2, 1.0, 0.0), (1, 0, 3, 1.0, 1.0),
    )
    with pytest.raises(Exception, match="consecutively"):
        ring_edges(rings).collect()


def test_empty_layer(frame):
    edges = frame("poly_id int, x1 double, y1 double, x2 double, y2 double")
    assert inside(frame("id int, x double, y double", (1, 0.0, 0.0)), edges).count() == 0


def test_points_of_short_rings_are_shuffled_once(frame):
    rings = frame("poly_id int, ring_id int, seq int, x double, y double", (1, 0, 0, 0.0, 0.0), (1, 0, 1, 1.0, 0.0), (1, 0, 2, 1.0, 1.0))
    plan = ring_edges(rings)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_sorted_points_are_those_of_the_joins(frame, monkeypatch, tuples):
    points = [(p, r, s + 5 * r, float(s % 3), float(s + (p or 0))) for p in (1, 2, None) for r in (0, 1) for s in range(6)]
    points += points[4:9] + points[20:30] + [(7, 0, 3, None, 1.0), (7, 0, 4, 2.0, 2.0), (7, 0, 5, 2.0, 3.0), (8, 0, 0, 1.0, 1.0)]
    rings = frame("poly_id int, ring_id int, seq int, x double, y double", *points)
    sorted_ones = tuples(ring_edges(rings))
    monkeypatch.setattr(polygons, "RING_POINTS", 0)
    assert "Join" in ring_edges(rings)._jdf.queryExecution().optimizedPlan().toString()
    assert sorted_ones == tuples(ring_edges(rings)) and len(sorted_ones) > 40


def test_tidy_deletes_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f.rsplit("/", 1)[1] for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = shuffled()
    with tidy(spark):
        assert stage(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "tidy").count() == 10
    until = time.time() + 20
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
