"""A trie of conversations: which opening turns they share, and what sharing saves.

Every distinct turn (role and text) is known by the 16 bytes of a digest, so a
conversation is a key of whole 16-byte ids. Sorted keys are cut into ranges, and each
range becomes an adaptive radix tree: a node keeps 4, 16, 48 or 256 children and grows
when it is full, and a run of bytes without a branch is one compressed path. Only byte
depths that are multiples of 16 are turns and give nodes; a compressed path gives one
for every turn on it.

Conversations that begin alike are neighbours, so only nodes on the way to the first or
last key of a range can reach into the next range. A range knows how many turns it
shares with its neighbours, counts a node's text only where the node is new and its
leaf only where the node ends, and so all numbers of such a node are sums over ranges:
one aggregation over a few rows per range finishes them. A conversation told a billion
times is spread over as many ranges as it fills; its row of ids alone is hashed in
order by one task, as the digest demands, which reads them range by range.

Defined results: turns are ordered by number, null first, equal numbers by the digest
of role and text; null roles and texts are empty; repeated rows are repeated turns;
rows without conv_id belong to no conversation and are left out; an empty table gives
an empty result, not even a root; extra columns are ignored. A conversation's ids (24
bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldtally.sources.staging import stage

#: Bytes of a turn's id.
WIDTH = 16
#: Conversations in a range, about: what one tree in a task's memory holds.
CONVERSATIONS_AT_ONCE = 50_000
#: Nodes shared by ranges (30 bytes each) that may be broadcast.
SHARED_AT_ONCE = 500_000
#: Turns that may come from the first conversation of a family, at most.
LENT = 8

_NOTHING = hashlib.sha256(b"").hexdigest()


class Node:
    """A node of an adaptive radix tree. ``path`` holds the bytes from its parent's end
    to its own, the branching byte first; ``ends`` the conversations that end here."""

    __slots__ = ("path", "ends", "sizes", "layout", "index", "children")

    def __init__(self, path: bytes) -> None:
        self.path, self.ends, self.sizes = path, [], None
        self.layout, self.index, self.children = 4, bytearray(), []

    def place(self, byte: int) -> int:
        """Where the child for a byte is, -1 if there is none."""
        if self.layout <= 16:
            return self.index.find(byte)
        if self.layout == 48:
            return self.index[byte] - 1
        return byte if self.children[byte] is not None else -1

    def add(self, byte: int, child: Node) -> None:
        if self.layout < 256 and len(self.children) == self.layout:
            self._grow()
        if self.layout <= 16:
            self.index.append(byte)
            self.children.append(child)
        elif self.layout == 48:
            self.children.append(child)
            self.index[byte] = len(self.children)
        else:
            self.children[byte] = child

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            places = bytearray(256)
            for at, byte in enumerate(self.index):
                places[byte] = at + 1
            self.layout, self.index = 48, places
        else:
            direct = [self.children[at - 1] if at else None for at in self.index]
            self.layout, self.index, self.children = 256, bytearray(), direct

    def in_order(self) -> list[Node]:
        """Children by their first bytes."""
        return sorted((c for c in self.children if c is not None), key=lambda c: c.path[0])


class Tree:
    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes) -> Node:
        """The node at which the key ends."""
        node, at = self.root, 0
        while at < len(key):
            place = node.place(key[at])
            if place < 0:
                fresh = Node(key[at:])
                node.add(key[at], fresh)
                return fresh
            child = node.children[place]
            if not key.startswith(child.path, at):
                same = len(os.path.commonprefix((child.path, key[at : at + len(child.path)])))
                upper = Node(child.path[:same])
                child.path = child.path[same:]
                upper.add(child.path[0], child)
                node.children[place] = child = upper
            node, at = child, at + len(child.path)
        return node


class Range:
    """The tree of one range of keys, with the turns its first key shares with the last
    key before (-1: there is none) and its last key with the first key after."""

    def __init__(self, part: int, before: int, after: int) -> None:
        self.part, self.before, self.after = part, before, after
        self.tree, self.first, self.last, self.at = Tree(), None, None, None

    def add(self, key: bytes, conv_id: int, sizes: list[int]) -> None:
        """Keys come sorted, equal keys by conv_id."""
        if key != self.last:
            self.at = self.tree.insert(key)
            self.at.sizes = sizes
            self.first, self.last = key if self.first is None else self.first, key
        self.at.ends.append(conv_id)

    def nodes(self) -> list[list]:
        """Rows of ``_ROW``, bottom up."""
        # Every node with its depth in bytes, whether the first and the last key pass it, and its parent.
        order = [(self.tree.root, 0, True, True, -1)]
        for at, (node, end, first, last, _) in enumerate(order):
            children = node.in_order()
            for child in children:
                order.append((
                    child, end + len(child.path), first and not node.ends and child is children[0],
                    last and child is children[-1], at,
                ))
        found, below = [], [[] for _ in order]
        for at in range(len(order) - 1, -1, -1):
            node, end, first, last, parent = order[at]
            folded = self._fold(node, end, first, last, below[at], found)
            below[at] = None
            if parent >= 0:
                below[parent].append(folded)
        return found

    def _fold(self, node, end, first, last, below, found):
        """Emit the turns on a node's path; return what its parent adds up: members,
        smallest member, leaves, saved tokens, sizes and the topmost rows."""
        members = len(node.ends) + sum(b[0] for b in below)
        least = min([b[1] for b in below] + node.ends[:1])
        leaves, saved = sum(b[2] for b in below), sum(b[3] for b in below)
        sizes = node.sizes if node.sizes is not None else below[0][4]
        tops = [row for b in below for row in b[5]]
        above = end - len(node.path)
        for depth in range(end // WIDTH, -1 if node is self.tree.root else above // WIDTH, -1):
            known, goes_on = first and depth <= self.before, last and depth <= self.after
            leaves += not tops and not goes_on
            if depth:
                saved += (members - (not known)) * sizes[depth - 1]
            ends = node.ends if depth * WIDTH == end else []
            children = sum(row[_FRESH] for row in tops)
            shared = None
            if known or goes_on:
                shared = hashlib.md5((self.first if known else self.last)[: depth * WIDTH]).digest()
            for row in tops:
                row[_PARENT], row[_ABOVE] = (None, shared) if shared else (least, None)
            told = ",".join(map(str, ends))
            row = [
                least, depth, None, members, children, leaves, saved,
                None if shared else hashlib.sha256(told.encode()).hexdigest() if told else _NOTHING,
                told if shared and told else None, shared, None, self.part, not known,
            ]
            found.append(row)
            tops = [row]
        return members, least, leaves, saved, sizes, tops


_ROW = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends_sha256", pa.string()), ("told", pa.string()), ("node", pa.binary()), ("above", pa.binary()),
    ("part", pa.int32()),
])
_PARENT, _ABOVE, _FRESH = 2, 10, 12
_SCHEMA = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, told string, node binary, above binary, part int"
)
COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, before, after, key, conv_id, sizes) to rows of nodes."""
    for (part, before, after), rows in groupby(_rows(batches), key=lambda r: r[:3]):
        tree = Range(part, before, after)
        for *_, key, conv_id, sizes in rows:
            tree.add(key, conv_id, sizes)
        found = tree.nodes()
        for at in range(0, len(found), 20_000):
            columns = list(zip(*found[at : at + 20_000]))[: len(_ROW)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, _ROW)], schema=_ROW
            )


def _shared_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, first, last, key before, key after) to turns shared on both sides."""

    def common(a: bytes, b: bytes | None) -> int:
        return -1 if b is None else len(os.path.commonprefix((a, b))) // WIDTH

    for batch in batches:
        part, first, last, before, after = (c.to_pylist() for c in batch.columns)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(part, type=pa.int32()),
                pa.array(map(common, first, before), type=pa.int32()),
                pa.array(map(common, last, after), type=pa.int32()),
            ],
            ["part", "before", "after"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (node, part, told) to the hash of what each node was told, in order
    and without holding it."""
    for node, rows in groupby(_rows(batches), key=lambda r: r[0]):
        told = hashlib.sha256()
        for at, row in enumerate(rows):
            told.update(("," if at else "").encode() + row[2].encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([node], type=pa.binary()), pa.array([told.hexdigest()])], ["node", "ends_sha256"]
        )


def rebuilt(conversations: DataFrame, family: int = 5, lent: int = LENT) -> DataFrame:
    """``conv_id, key, sizes``: each conversation with its first turns replaced by those
    of the first conversation of its family, as one key of turn ids, and the bytes of
    each text. crc32(conv_id) modulo ``lent + 1`` says how many turns are lent."""
    conv_id = F.col("conv_id").cast("long")
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turn_id = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    size = F.octet_length(text).cast("long")
    turn = F.struct(F.col("turn").alias("turn"), turn_id.alias("id"), size.alias("size"))
    turns = conversations.select(conv_id.alias("conv_id"), turn.alias("turn")).filter("conv_id IS NOT NULL")
    # One exchange by family serves the grouping by conversation and the window.
    own = (
        turns.withColumn("family", F.col("conv_id") - F.col("conv_id") % family)
        .repartition("family")
        .groupBy("family", "conv_id")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    )
    first = F.first(
        F.when(F.col("conv_id") == F.col("family"), F.slice("turns", 1, lent)), ignorenulls=True
    ).over(Window.partitionBy("family"))
    borrowed = (F.crc32(F.col("conv_id").cast("string")) % (lent + 1)).cast("int")
    told = F.concat(
        F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("borrowed")),
        F.slice("turns", F.col("borrowed") + 1, F.size("turns")),
    )
    return (
        own.withColumn("first", first)
        .withColumn("borrowed", borrowed)
        .select("conv_id", told.alias("told"))
        .select(
            "conv_id",
            F.unhex(F.array_join(F.transform("told", lambda t: F.hex(t["id"])), "")).alias("key"),
            F.transform("told", lambda t: t["size"]).alias("sizes"),
        )
    )


def trie_nodes(keys: DataFrame, at_once: int = CONVERSATIONS_AT_ONCE) -> DataFrame:
    """One row of ``COLUMNS`` per node of the trie over ``keys`` (conv_id, key, sizes),
    one row per conversation; ``at_once`` conversations make a range, about."""
    keys = stage(keys, "conversation_keys")
    parts = keys.count() // at_once + 1
    ranges = stage(
        keys.repartitionByRange(parts, "key", "conv_id").withColumn("part", F.spark_partition_id()),
        "conversation_ranges",
    )
    # One row per range, so the window over all of them is small beside the keys.
    beside = Window.orderBy("part")
    shared = (
        ranges.groupBy("part")
        .agg(F.min("key").alias("first"), F.max("key").alias("last"))
        .select("part", "first", "last", F.lag("last").over(beside), F.lead("first").over(beside))
        .mapInArrow(_shared_turns, "part int, before int, after int")
    )
    nodes = stage(
        ranges.join(F.broadcast(shared), "part")
        .select("part", "before", "after", "key", "conv_id", "sizes")
        .repartition(parts, "part")
        .sortWithinPartitions("part", "key", "conv_id")
        .mapInArrow(_build, _SCHEMA),
        "conversation_nodes",
    )
    across = nodes.filter("node IS NOT NULL")
    told = (
        across.filter("told IS NOT NULL")
        .select("node", "part", "told")
        .repartition("node")
        .sortWithinPartitions("node", "part")
        .mapInArrow(_digest, "node binary, ends_sha256 string")
    )
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    across = stage(
        across.groupBy("node")
        .agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("above").alias("above"), *sums)
        .join(told, "node", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING))),
        "conversation_nodes_across",
    )
    above = across.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    if across.count() <= SHARED_AT_ONCE:
        above = F.broadcast(above)
    inside = nodes.filter("node IS NULL")
    return (
        inside.filter("above IS NULL").select(COLUMNS)
        .unionByName(inside.filter("above IS NOT NULL").drop("parent_conv_id").join(above, "above").select(COLUMNS))
        .unionByName(across.join(above, "above", "left").select(COLUMNS))
    )


def conversation_trie(conversations: DataFrame, at_once: int = CONVERSATIONS_AT_ONCE) -> DataFrame:
    """The trie over the rebuilt conversations (see ``rebuilt``)."""
    return trie_nodes(rebuilt(conversations), at_once)


def op11_radix_trie(spark, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
    range(1, length({0}) + 1), lambda i: [ascii(substr({0}, i, 1)), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295::BIGINT)"""

#: Prefixes of keys as texts, every node joined with all nodes above it.
OP11_SQL = f"""
WITH ordered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n
    FROM conversations WHERE conv_id IS NOT NULL),
told AS (SELECT conv_id, {_CRC32.format('conv_id::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM ordered)),
turns AS (
    SELECT t.conv_id, o.n, o.role, o.text FROM told t JOIN ordered o ON o.conv_id = t.conv_id - t.conv_id % 5 AND o.n <= t.h
    UNION ALL
    SELECT t.conv_id, o.n, o.role, o.text FROM told t JOIN ordered o ON o.conv_id = t.conv_id AND o.n > t.h),
ids AS (
    SELECT conv_id, strlen(text) AS size, md5(strlen(role) || ':' || role || text) AS id,
        row_number() OVER (PARTITION BY conv_id ORDER BY n) AS n
    FROM turns),
keys AS (
    SELECT t.conv_id, coalesce(string_agg(id, '' ORDER BY n), '') AS key,
        coalesce(list(size ORDER BY n) FILTER (WHERE id IS NOT NULL), []) AS sizes
    FROM told t LEFT JOIN ids i ON i.conv_id = t.conv_id GROUP BY t.conv_id),
members AS (
    SELECT conv_id, substr(key, 1, 32 * d) AS prefix, d, len(sizes) = d AS ends, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
    FROM (SELECT *, unnest(range(0, len(sizes) + 1)) AS d FROM keys)),
nodes AS (
    SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(size) AS own,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM members GROUP BY prefix, d),
children AS (SELECT substr(prefix, 1, 32 * (depth - 1)) AS prefix, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (
    SELECT substr(prefix, 1, 32 * d) AS prefix, d AS depth, sum(leaf) AS n_leaves, sum(own) AS saved_tokens
    FROM (
        SELECT n.prefix, n.own, CASE WHEN c.n IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(0, n.depth + 1)) AS d
        FROM nodes n LEFT JOIN children c USING (prefix, depth))
    GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
    b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (prefix, depth) LEFT JOIN children c USING (prefix, depth)
LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.prefix = substr(n.prefix, 1, 32 * (n.depth - 1))
"""
