"""Vector codes against exact brute force and against SQL; the trees by themselves."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from check import canonical, connect
from fieldtally.llm import vector_codes as codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, trees string, of_label string"
SMALLEST = "/root/testdata/sf0.001"


def _brute(rows, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    """Codes and codebooks with Python's integers; rows are (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    whole = [[math.floor(codes.SCALE * int(x)) if abs(x) > 2**53 else math.floor(codes.SCALE * x) for x in r[1]] for r in kept]
    whole = [v + [0] * (width - len(v)) for v in whole]
    step = width // parts
    cut = [[v[p * step : (p + 1) * step] for v in whole] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def near(book, x):
        return min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(book[e], x)), e))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for x in cut[p]:
                groups.setdefault(near(book, x), []).append(x)
            books[p] = [
                [sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else entry
                for e, entry in enumerate(book)
            ]
    found = []
    for i, row in enumerate(kept):
        names = [near(books[p], cut[p][i]) for p in range(parts)]
        error = sum((a - b) ** 2 for p in range(parts) for a, b in zip(books[p][names[p]], cut[p][i]))
        found.append((row[0], "".join(f"{n:02x}" for n in names), error if error < 2**63 else None, row[2]))
    return found, books


def _check(spark, rows, block=codes.BLOCK, schema=SCHEMA):
    table = spark.createDataFrame([(*r, "c", "t", "o") for r in rows], schema)
    coded, books = codes.vector_codes(table, block=block)
    expected, brute = _brute([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], b) for i, v, b in rows])
    assert books == brute
    ours = [(r["vec_id"], r["code"], r["error"], None if r["label"] is None else int(r["label"])) for r in coded.collect()]
    assert sorted(ours, key=repr) == sorted(expected, key=repr)
    return coded


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 24))
    rows = []
    for i in range(700):
        vector = centres[i % 6] + rng.normal(scale=0.03, size=24)
        rows.append((i * 3, vector.astype(np.float32).tolist(), i % 4 or None))
    rows += [(5000 + i, [0.25] * 24, 9) for i in range(150)]  # one common vector
    random.Random(2).shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [64, 300, 4096])
def test_codes_against_brute_force(spark, clustered, block):
    _check(spark, clustered, block)


def test_sql(spark):
    ours = codes.op12_anchor_codes(spark, SMALLEST).toPandas()
    theirs = connect(SMALLEST).execute(codes.OP12_SQL).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and canonical(ours) == canonical(theirs)


def test_odd_vectors(spark):
    rows = [
        (None, [1.0] * 16, 1), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan")] * 16, 1),
        (6, [float("inf")] + [0.0] * 15, 1), (7, [0.5] * 16, None), (7, [0.5] * 16, None), (7, [-0.5] * 16, None),
        (8, [], 2), (9, [1e-4, -1e-4] * 9, 2), (2, [3.0] * 3, 2),
    ]
    coded = _check(spark, rows)
    totals = {}
    for row in codes.with_label_error(coded).collect():
        totals.setdefault(row["label"], set()).add(row["label_error"])
    assert set(totals) == {"1", "2", None} and all(len(v) == 1 for v in totals.values())
    assert totals[None] == {sum(r["error"] for r in coded.collect() if r["label"] is None)}


def test_huge_components_stay_exact(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([1.0, 3e38, -3e38, 7e9, 0.1, -2.5]) for _ in range(16)], 0) for i in range(40)]
    _check(spark, rows, block=16)


def test_empty_and_zero_width(spark):
    table = spark.createDataFrame([], SCHEMA)
    coded, books = codes.vector_codes(table)
    assert codes.with_label_error(coded).count() == 0 and books == [[]] * codes.PARTS
    _check(spark, [(1, [], 0), (2, [], 0)])


def test_fewer_vectors_than_entries_and_unused_entries(spark):
    _check(spark, [(i, [float(i % 2)] * 8, i) for i in range(5)])


@pytest.mark.parametrize("value", [0, 5, -5, 2**40, -(2**40), 2**95 + 17, -(2**130) - 3])
def test_digits(value):
    assert sum(d << (codes.DIGIT * p) for p, d in codes._digits(value)) == value
    assert all(abs(d) <= 2**40 for _, d in codes._digits(value))


def _tree(points):
    points = np.unique(points, axis=0)
    weights = np.arange(1, len(points) + 1)
    return points, weights, codes.Tree(points, weights)


def test_balls_hold_their_points_sums_and_counts():
    rng = np.random.default_rng(9)
    points, weights, tree = _tree(rng.integers(-900, 900, (1500, 8)))
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for lo, hi, s, n, c, r in zip(tree.lo, tree.hi, tree.sums, tree.counts, tree.centre, tree.radius):
        own = tree.order[lo:hi]
        assert (s == (points[own] * weights[own, None]).sum(axis=0)).all() and n == weights[own].sum()
        assert (np.sqrt(((points[own] - c) ** 2).sum(axis=1)) <= r).all()
    inner = np.flatnonzero(tree.left >= 0)
    assert all(tree.lo[i] == tree.lo[tree.left[i]] and tree.hi[i] == tree.hi[tree.right[i]] for i in inner)
    assert max(tree.hi[i] - tree.lo[i] for i in np.flatnonzero(tree.left < 0)) <= codes.LEAF


def test_points_belong_to_their_nearest_anchor():
    rng = np.random.default_rng(6)
    points = rng.normal(size=(400, 4))
    groups = codes._anchors(points, np.arange(400))
    assert sorted(np.concatenate(groups).tolist()) == list(range(400))
    assert 15 <= len(groups) <= 21


def test_balls_are_owned_whole_and_ties_go_to_the_lower_entry(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (5, 8))
    points, weights, tree = _tree(centres[rng.integers(0, 5, 3000)] + rng.integers(-40, 40, (3000, 8)))
    points, weights = points[tree.order], weights[tree.order]
    measured = []
    plain = codes._nearest
    monkeypatch.setattr(codes, "_nearest", lambda p, e: measured.append(len(p)) or plain(p, e))
    nearest, sums, counts = tree.assign(points, weights, centres)
    assert sum(measured) < 0.1 * len(points)
    assert (nearest == plain(points, centres)).all() and counts.sum() == weights.sum()
    assert all((sums[e] == (points[nearest == e] * weights[nearest == e, None]).sum(axis=0)).all() for e in range(5))
    twice = np.concatenate([centres, centres, centres[:1] + 1])
    assert (tree.assign(points, weights, twice)[0] == plain(points, twice)).all()


def test_digest_of_codebooks(spark):
    row = codes.op12_anchor_codes(spark, SMALLEST).first()
    _, books = codes.vector_codes(spark.read.parquet(f"{SMALLEST}/embeddings.parquet"))
    told = ",".join(str(x) for b in books for e in b for x in e)
    assert row["codebooks_sha256"] == hashlib.sha256(told.encode()).hexdigest()
