"""The trie of conversations against a brute-force trie and against SQL."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from check import canonical, connect
from fieldtally.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, part int, node string"
SMALLEST = "/root/testdata/sf0.001"


def _brute(rows):
    told = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            told.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(t, key=lambda t: t[:2])] for c, t in told.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    found = []
    for prefix, convs in members.items():
        d = len(prefix)
        below = [p for p in members if p[:d] == prefix]
        inner = {p[:-1] for p in members if p}
        ends = sorted(c for c in convs if built[c] == prefix)
        found.append((
            min(convs), d, min(members[prefix[:-1]]) if d else None, len(convs),
            sum(len(p) == d + 1 for p in below), sum(p not in inner for p in below),
            sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(found, key=repr)


def _found(table):
    return sorted((tuple(r[c] for c in trie.COLUMNS) for r in table.collect()), key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = []
    for conv in range(60):
        if conv % 7 == 3:
            continue
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, rng.choice(["user", "bot"]), rng.choice(["a", "b", "", "ä", "😀 long"])))
    rows += [(conv, turn, "user", "same") for conv in range(100, 180) for turn in range(3)]
    rows += [(900, turn, "user", f"t{turn}") for turn in range(150)]
    rows += [(905, turn, "user", f"t{turn}") for turn in range(120)]
    rows += [(200, None, "user", "first"), (200, 4, None, "x"), (200, 2, "user", None), (-7, 0, "user", "a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("at_once", [3, 25, 50_000])
def test_nodes_against_brute_force(spark, talks, at_once):
    table = spark.createDataFrame([(*r, "k", 1, "n") for r in talks], SCHEMA)
    assert _found(trie.conversation_trie(table, at_once)) == _brute(talks)


def test_sql(spark):
    ours = trie.op11_radix_trie(spark, SMALLEST).toPandas()
    theirs = connect(SMALLEST).execute(trie.OP11_SQL).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and canonical(ours) == canonical(theirs)


def test_rows_without_a_conversation_and_repeated_rows(spark):
    rows = [(None, 0, "user", "lost"), (10, 1, "user", "b"), (10, 0, "user", "a"), (10, 0, "user", "a"), (None,) * 4]
    table = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    found = _found(trie.conversation_trie(table))
    assert found == _brute(rows) and max(r[1] for r in found) == 3
    assert _found(trie.conversation_trie(table.unionByName(table).filter("conv_id IS NULL"))) == []
    assert _found(trie.conversation_trie(table.limit(0))) == []


def test_equal_turn_numbers_have_an_order(spark):
    rows = [(5, 1, "user", "b", None, None, None), (5, 1, "bot", "a", None, None, None)]
    both = [trie.rebuilt(spark.createDataFrame(r, SCHEMA)).first()["key"] for r in (rows, rows[::-1])]
    assert both[0] == both[1]


def test_a_conversation_may_end_without_turns(spark):
    conv = next(c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(conv, 0, "user", "a", None, None, None), (conv, 1, "bot", "b", None, None, None)]
    found = _found(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)))
    assert found == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


@pytest.mark.parametrize("children, layout", [(3, 4), (4, 4), (5, 16), (16, 16), (17, 48), (48, 48), (49, 256), (256, 256)])
def test_node_layouts_grow(children, layout):
    tree, order = trie.Tree(), list(range(children))
    random.Random(children).shuffle(order)
    ends = {byte: tree.insert(bytes([7, byte, 9, 9])) for byte in order}
    (node,) = tree.root.in_order()
    assert node.layout == layout and [c.path[0] for c in node.in_order()] == sorted(order)
    assert all(tree.insert(bytes([7, byte, 9, 9])) is ends[byte] for byte in order)
    assert all(child.path == bytes([child.path[0], 9, 9]) for child in node.in_order())


def test_paths_are_compressed_and_split():
    tree = trie.Tree()
    first = tree.insert(b"abcdefgh")
    assert tree.root.in_order() == [first] and first.path == b"abcdefgh"
    second = tree.insert(b"abcdxy")
    (upper,) = tree.root.in_order()
    assert upper.path == b"abcd" and upper.in_order() == [first, second]
    assert tree.insert(b"abcd") is upper and tree.insert(b"") is tree.root
