"""Vectors as short codes: every part of a vector is named by its nearest entry in the
part's codebook, and the codebooks are learnt from all vectors.

Components are integers (floor of 4096 times the number), so every sum and distance is
exact. Blocks of vectors are written once; for each part of a block an anchors
hierarchy is built and written with it: anchors are picked far apart and steal the
points that are nearer to them, the anchors' balls are joined upwards by least radius
and divided downwards again. A ball caches the sum and the count of its points. In a
round each block walks down its trees: a ball inherits the entries that can still be
nearest to some point of it, drops those beaten everywhere by its centre's nearest, and
hands its cached sum over as soon as one is left. Only points of small balls that
several entries share are measured one by one, with exact distances.

A round shuffles sums, at most one row per task, entry and component, and the driver
holds the codebooks, whose size the corpus does not change.

Defined results: rows whose vector is null or has a null or non-finite component are
left out; shorter vectors are continued with zeros up to the longest length, rounded up
to a multiple of the parts; null ids come last, rows of equal ids in the order of their
vectors; repeated rows are coded each; equal points take the same entry, equal distances
the lower one; an error beyond a long is null; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator
from math import floor, isqrt, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.sources.staging import stage

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Vectors that share a tree.
BLOCK = 4096
#: Points of a ball that is not divided further.
LEAF = 48
#: Labels (some 30 bytes each) that may be broadcast to the coded rows.
LABELS_AT_ONCE = 500_000
#: Sums travel in digits of this many bits, so that adding them never overflows.
DIGIT = 40
_MOST = 2**63 - 1


def _integers(vectors: list[np.ndarray], width: int) -> np.ndarray:
    """floor(SCALE * x), padded with zeros; Python's integers where 64 bits are not enough."""
    scaled = np.zeros((len(vectors), width))
    for row, vector in zip(scaled, vectors):
        row[: len(vector)] = vector
    with np.errstate(over="ignore"):
        scaled = np.floor(scaled * SCALE)
    if np.abs(scaled).max(initial=0) <= _safe(width):
        return scaled.astype(np.int64)
    exact = np.empty((len(vectors), width), dtype=object)
    exact[:] = 0
    for i, vector in enumerate(vectors):
        # Beyond 2 ** 53 a double is a whole number, and so is its multiple.
        exact[i, : len(vector)] = [floor(x) * SCALE if abs(x) >= 2**53 else floor(x * SCALE) for x in vector.tolist()]
    return exact


def _safe(width: int) -> int:
    """Components up to this size keep squared distances over a whole vector in 64 bits."""
    return isqrt(2**60 // max(width, 1)) // 2


class Part:
    """The distinct points of one part of a block, with their tree unless they are too large."""

    def __init__(self, points: np.ndarray) -> None:
        self.tree = None
        if points.dtype == object or not points.shape[1]:
            self.points, self.place = points, np.arange(len(points))
            self.weights = np.ones(len(points), dtype=np.int64)
            return
        self.points, self.place, self.weights = np.unique(points, axis=0, return_inverse=True, return_counts=True)
        self.place = self.place.ravel()
        self.tree = Tree(self.points, self.weights)
        back = np.empty(len(self.points), dtype=np.int64)
        back[self.tree.order] = np.arange(len(back))
        self.points, self.weights, self.place = self.points[self.tree.order], self.weights[self.tree.order], back[self.place]

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of every distinct point, and the sums and counts of the entries."""
        if self.tree is not None and entries.dtype != object:
            return self.tree.assign(self.points, self.weights, entries)
        nearest = _nearest(self.points.astype(object), entries.astype(object))
        sums = np.zeros(entries.shape, dtype=object)
        np.add.at(sums, nearest, self.points.astype(object) * self.weights[:, None])
        return nearest, sums, np.bincount(nearest, weights=self.weights, minlength=len(entries)).astype(np.int64)

    def errors(self, entries: np.ndarray, nearest: np.ndarray) -> np.ndarray:
        """Squared distance of every point of the block."""
        wide = object if entries.dtype == object or self.points.dtype == object else np.int64
        apart = self.points.astype(wide) - entries.astype(wide)[nearest]
        return (apart * apart).sum(axis=1)[self.place]


def _nearest(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    apart = points[:, None, :] - entries[None, :, :]
    return np.argmin((apart * apart).sum(axis=2), axis=1).astype(np.int64)


class Tree:
    """Balls over points. Those of a ball are ``lo`` to ``hi`` in the tree's order."""

    def __init__(self, points: np.ndarray, weights: np.ndarray) -> None:
        self.left, self.right, members = [], [], []
        self.root = self._grow(points.astype(np.float64), np.arange(len(points)), members)
        self.left, self.right = np.array(self.left), np.array(self.right)
        self._lay_out(members)
        sums = np.zeros((len(points) + 1, points.shape[1]), dtype=np.int64)
        np.cumsum(points[self.order] * weights[self.order, None], axis=0, out=sums[1:])
        counts = np.append(0, np.cumsum(weights[self.order]))
        self.sums, self.counts = sums[self.hi] - sums[self.lo], counts[self.hi] - counts[self.lo]
        self.centre = self.sums / self.counts[:, None]
        ordered = points[self.order].astype(np.float64)
        far = [
            sqrt(((ordered[lo:hi] - c) ** 2).sum(axis=1).max()) for lo, hi, c in zip(self.lo, self.hi, self.centre)
        ]
        # A little more than rounding can take away.
        self.radius = np.array(far) * (1 + 1e-9) + 1e-6

    def _node(self, left: int, right: int, members: list, own) -> int:
        self.left.append(left)
        self.right.append(right)
        members.append(own)
        return len(self.left) - 1

    def _grow(self, points: np.ndarray, own: np.ndarray, members: list) -> int:
        """The ball of points ``own``; balls are made bottom up."""
        groups = _anchors(points, own) if len(own) > LEAF else [own]
        if len(groups) == 1:
            return self._node(-1, -1, members, own)
        balls = [self._grow(points, group, members) for group in groups]
        centres = np.array([points[g].mean(axis=0) for g in groups])
        radii = np.array([np.sqrt(((points[g] - c) ** 2).sum(axis=1).max()) for g, c in zip(groups, centres)])
        sizes = np.array([len(g) for g in groups], dtype=np.float64)
        return self._join(balls, centres, radii, sizes, members)

    def _join(self, balls, centres, radii, sizes, members) -> int:
        """Join the two balls whose common ball is smallest until one is left."""

        def common(at):
            apart = np.sqrt(((centres - centres[at]) ** 2).sum(axis=1))
            return np.maximum(np.maximum(radii, radii[at]), (apart + radii + radii[at]) / 2)

        table = np.array([common(i) for i in range(len(balls))])
        np.fill_diagonal(table, np.inf)
        for _ in range(len(balls) - 1):
            a, b = divmod(int(np.argmin(table)), len(balls))
            balls[a] = self._node(balls[a], balls[b], members, None)
            centre = (centres[a] * sizes[a] + centres[b] * sizes[b]) / (sizes[a] + sizes[b])
            radii[a] = max(np.sqrt(((centres[i] - centre) ** 2).sum()) + radii[i] for i in (a, b))
            centres[a], sizes[a] = centre, sizes[a] + sizes[b]
            gone = np.isinf(table[a]) & (np.arange(len(balls)) != a)
            table[a] = np.where(gone, np.inf, common(a))
            table[a, [a, b]] = np.inf
            table[:, a] = table[a]
            table[b], table[:, b] = np.inf, np.inf
        return balls[a]

    def _lay_out(self, members: list) -> None:
        self.lo, self.hi = np.zeros(len(members), dtype=np.int64), np.zeros(len(members), dtype=np.int64)
        order, at, stack = [], 0, [(self.root, False)]
        while stack:
            node, done = stack.pop()
            if done:
                self.lo[node], self.hi[node] = self.lo[self.left[node]], self.hi[self.right[node]]
            elif members[node] is not None:
                order.append(members[node])
                self.lo[node], at = at, at + len(members[node])
                self.hi[node] = at
            else:
                stack += [(node, True), (self.right[node], False), (self.left[node], False)]
        self.order = np.concatenate(order)

    def assign(self, points: np.ndarray, weights: np.ndarray, entries: np.ndarray):
        sums, counts = np.zeros(entries.shape, dtype=np.int64), np.zeros(len(entries), dtype=np.int64)
        nearest = np.full(len(points), -1, dtype=np.int64)
        table = entries.astype(np.float64)
        between = np.sqrt(((table[:, None] - table[None]) ** 2).sum(axis=2))
        balls, lists = np.array([self.root]), np.ones((1, len(entries)), dtype=bool)
        while len(balls):
            away = ((self.centre[balls][:, None, :] - table[None]) ** 2).sum(axis=2)
            best = np.argmin(np.where(lists, away, np.inf), axis=1)
            least = away[np.arange(len(balls)), best]
            # Beaten at every point of the ball, by more than rounding can hide.
            margin = away - least[:, None] - 2 * self.radius[balls][:, None] * between[best]
            lists &= margin <= 1e-9 * (away + least[:, None]) + 1e-6
            lists[np.arange(len(balls)), best] = True
            owned, leaf = lists.sum(axis=1) == 1, self.left[balls] < 0
            np.add.at(sums, best[owned], self.sums[balls[owned]])
            np.add.at(counts, best[owned], self.counts[balls[owned]])
            for ball, entry in zip(balls[owned], best[owned]):
                nearest[self.lo[ball] : self.hi[ball]] = entry
            further = ~owned & ~leaf
            at = balls[further]
            balls, lists = np.append(self.left[at], self.right[at]), np.tile(lists[further], (2, 1))
        shared = np.flatnonzero(nearest < 0)
        nearest[shared] = _nearest(points[shared], entries)
        np.add.at(sums, nearest[shared], points[shared] * weights[shared, None])
        np.add.at(counts, nearest[shared], weights[shared])
        return nearest, sums, counts


def _anchors(points: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
    """About the square root of ``own`` in groups around anchors, each the point that
    was farthest from its own anchor."""
    mine = points[own]
    anchors = [mine[0]]
    owner = np.zeros(len(own), dtype=np.int64)
    away = np.sqrt(((mine - mine[0]) ** 2).sum(axis=1))
    for fresh in range(1, isqrt(len(own) - 1) + 1):
        far = int(np.argmax(away))
        if away[far] == 0:
            break
        spacing = np.sqrt(((np.array(anchors) - mine[far]) ** 2).sum(axis=1))
        # A point within half the way to the new anchor stays, by the triangle inequality.
        asked = np.flatnonzero(away > spacing[owner] / 2)
        there = np.sqrt(((mine[asked] - mine[far]) ** 2).sum(axis=1))
        stolen = there < away[asked]
        owner[asked[stolen]], away[asked[stolen]] = fresh, there[stolen]
        anchors.append(mine[far])
    by_owner = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[by_owner])) + 1
    return [own[g] for g in np.split(by_owner, cuts)]


def _blocks(width: int, parts: int, block: int):
    """Rows (vec_id, label, embedding) to blocks with their trees."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                rows = batch.slice(at, block)
                vectors = [np.array(v, dtype=np.float64) for v in rows.column(2).to_pylist()]
                matrix, step = _integers(vectors, width), width // parts
                trees = pickle.dumps([Part(matrix[:, p * step : (p + 1) * step]) for p in range(parts)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows.column(0).to_pylist()], type=pa.list_(pa.int64())),
                        pa.array([rows.column(1).to_pylist()], type=pa.list_(pa.string())),
                        pa.array([trees], type=pa.binary()),
                    ],
                    ["ids", "labels", "trees"],
                )

    return build


def _entries(codebook: list[list[int]], width: int, parts: int) -> np.ndarray:
    exact = np.array(codebook, dtype=object).reshape(len(codebook), width // parts)
    small = max((abs(x) for row in codebook for x in row), default=0) <= _safe(width)
    return exact.astype(np.int64) if small else exact


def _summing(codebooks: list[list[list[int]]], width: int):
    """Blocks to the digits of the sums and counts of all entries in a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [_entries(c, width, len(codebooks)) for c in codebooks]
        totals: dict[tuple[int, int, int], int] = defaultdict(int)
        for batch in batches:
            for trees in batch.column(0):
                for p, part in enumerate(pickle.loads(trees.as_py())):
                    _, sums, counts = part.assign(entries[p])
                    for e in np.flatnonzero(counts).tolist():
                        totals[p, e, -1] += int(counts[e])
                        for i, value in enumerate(sums[e].tolist()):
                            totals[p, e, i] += value
        rows = [(*key, *digit) for key, value in totals.items() for digit in _digits(value)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], type=pa.int64()) for i in range(5)],
            ["part", "entry", "place", "digit", "value"],
        )

    return add


def _digits(value: int) -> list[tuple[int, int]]:
    """A number as (place, digit); only the last digit has a sign."""
    found = []
    while not -(1 << DIGIT) <= value < 1 << DIGIT:
        found.append((len(found), value & ((1 << DIGIT) - 1)))
        value >>= DIGIT
    return [*found, (len(found), value)]


def _coding(codebooks: list[list[list[int]]], width: int):
    """Blocks to rows (vec_id, label, code, error)."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = [_entries(c, width, len(codebooks)) for c in codebooks]
        for batch in batches:
            for ids, labels, trees in zip(*batch.columns):
                names, errors = [], 0
                for part, book in zip(pickle.loads(trees.as_py()), entries):
                    nearest, _, _ = part.assign(book)
                    names.append(nearest[part.place])
                    errors = errors + part.errors(book, nearest).astype(object)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.values, labels.values,
                        pa.array([bytes(row).hex() for row in np.stack(names, axis=1).astype(np.uint8)]),
                        pa.array([int(e) if e <= _MOST else None for e in errors], type=pa.int64()),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return code


def learn(trees: DataFrame, codebooks: list[list[list[int]]], width: int, rounds: int = ROUNDS) -> list:
    """``rounds`` times: give every part to its nearest entry, move each used entry to
    the floor of the mean of its parts."""
    for _ in range(rounds):
        digits = (
            trees.select("trees")
            .mapInArrow(_summing(codebooks, width), "part long, entry long, place long, digit long, value long")
            .groupBy("part", "entry", "place", "digit")
            .agg(F.sum("value").alias("value"))
            .collect()  # at most parts x entries x components, and a few digits each
        )
        totals: dict[tuple[int, int, int], int] = defaultdict(int)
        for row in digits:
            totals[row["part"], row["entry"], row["place"]] += row["value"] << (DIGIT * row["digit"])
        codebooks = [
            [
                [totals[p, e, i] // totals[p, e, -1] for i in range(len(entry))] if totals[p, e, -1] else entry
                for e, entry in enumerate(book)
            ]
            for p, book in enumerate(codebooks)
        ]
    return codebooks


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, block: int = BLOCK
) -> tuple[DataFrame, list[list[list[int]]]]:
    """One row ``vec_id, label, code, error`` per usable row of ``vectors`` (vec_id,
    embedding, label), and the codebooks by part and entry. ``entries`` is at most 256."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).filter(F.col("embedding").isNotNull() & finite)
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // parts) * parts
    firsts = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    matrix = _integers([np.array(r["embedding"], dtype=np.float64) for r in firsts], width)
    step = width // parts
    codebooks = [matrix[:, p * step : (p + 1) * step].tolist() for p in range(parts)]
    trees = stage(
        kept.mapInArrow(_blocks(width, parts, block), "ids array<long>, labels array<string>, trees binary"),
        "vector_trees",
    )
    codebooks = learn(trees, codebooks, width, rounds)
    coded = trees.mapInArrow(_coding(codebooks, width), "vec_id long, label string, code string, error long")
    return coded, codebooks


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over all rows of an equal label."""
    coded = stage(coded, "vector_codes")
    totals = stage(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), "vector_labels")
    totals = totals.withColumnRenamed("label", "of_label")
    if totals.count() <= LABELS_AT_ONCE:
        totals = F.broadcast(totals)
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")


def op12_anchor_codes(spark, sf_dir: str) -> DataFrame:
    coded, codebooks = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    told = ",".join(str(x) for book in codebooks for entry in book for x in entry)
    digest = hashlib.sha256(told.encode()).hexdigest()
    return with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _sql() -> str:
    """Every round as its own tables; a part's entry is a list."""
    steps = [
        f"""
nearest{r} AS MATERIALIZED (
    SELECT v.n, v.part, min_by(b.entry, b.far) AS entry, min(b.far) AS far
    FROM (
        SELECT v.n, v.part, b.entry, struct_pack(d := list_sum(list_transform(list_zip(v.x, b.x),
            lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, e := b.entry) AS far
        FROM points v JOIN book{r} b USING (part)) b
    JOIN points v USING (n, part) GROUP BY v.n, v.part)"""
        + (
            f""",
book{r + 1} AS MATERIALIZED (
    SELECT b.part, b.entry, coalesce(m.x, b.x) AS x
    FROM book{r} b LEFT JOIN (
        SELECT part, entry, list(mean ORDER BY i) AS x FROM (
            SELECT part, entry, i, floor(sum(x[i]) / count(*))::BIGINT AS mean
            FROM (SELECT p.part, a.entry, p.x, unnest(range(1, len(p.x) + 1)) AS i FROM points p JOIN nearest{r} a USING (n, part))
            GROUP BY part, entry, i)
        GROUP BY part, entry) m USING (part, entry))"""
            if r < ROUNDS
            else ""
        )
        for r in range(ROUNDS + 1)
    ]
    return f"""
WITH kept AS (
    SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label,
        list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
points AS MATERIALIZED (
    SELECT n, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x
    FROM kept, range(0, {PARTS}) r(part)),
book0 AS (SELECT part, n - 1 AS entry, x FROM points WHERE n <= {ENTRIES}),
{",".join(steps)},
told AS (
    SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS}),
coded AS (
    SELECT n, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far.d)::BIGINT AS error
    FROM nearest{ROUNDS} GROUP BY n)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, codebooks_sha256
FROM kept k JOIN coded c USING (n), told
"""


OP12_SQL = _sql()
