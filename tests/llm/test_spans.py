"""Personal data, benchmark passages and repeated passages."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import regex

from pyspark.sql import functions as F

from fieldtally.llm import decontamination, passages, personal
from tests.llm.conftest import SMALLEST

# The base patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_spans(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in BASE.items() for m in re.finditer(pattern, text or "") if valid(kind, m.group())
    ]


TRICKY = [
    "a@b.c_d@e.f a@b@c.d x@y .@-.- é@a.bé 😀 p+q%r@s-t.u.v.", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 001.02.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111 " + "1" * 3000, "+1 (555) 123-4567 +12 +1.2.3.4.5.6.7.8",
    "call +49 30 901820 or +1 202 555 0100.", "version 1.2.3.4 of 10.0.0.1\n192.168.1.300", "0000 0000 0000 0000",
    "+1 (502) 555-6996 5500-0000-0000-0004", "@@@ a@@b.c " + "x" * 5000 + "@", "", None,
]


def test_base_spans_are_those_of_plain_python(spark, documents, texts):
    every = texts | {-i: t for i, t in enumerate(TRICKY, 1)}
    docs = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    for row in personal.with_spans(docs, personal.SpanModel()).collect():
        found = [(s["kind"], s["start"], s["end"]) for s in row["pii_base"]]
        assert found == base_spans(every[row["doc_id"]]), every[row["doc_id"]][:80]


def test_query_digest(spark, texts):
    for row in personal.op9_weak_supervision(spark, SMALLEST).collect():
        spans = base_spans(texts[row["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(row["spans"].split(","))
        assert [row[f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in spans) for k in BASE]


def test_method_adds_spans_with_evidence_and_leaves_numbers_alone(spark):
    rows = [
        *((i, f"login with password: hunter{i}secret99x please") for i in range(40)),
        *((100 + i, f"my mail is person{i} (at) example (dot) com thanks") for i in range(40)),
        *((200 + i, f"order no. 200-55{i % 10}-12{i % 10}4 of release") for i in range(40)),
        *((300 + i, f"write to me{i}@example.com") for i in range(40)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = {
        r["doc_id"]: {s["kind"] for s in r["pii_spans"]}
        for r in personal.with_spans(docs, personal.fit(docs)).collect()
    }
    assert all(kinds[i] == {"secret"} for i in range(40))
    assert all("spelled_email" in kinds[100 + i] for i in range(40))
    assert not any(kinds[200 + i] for i in range(40))
    assert all(kinds[300 + i] == {"email"} for i in range(40))


def test_reliabilities_are_recovered():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.4
    accuracy = [0.95, 0.9, 0.8, 0.7, 0.6, 0.55]
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth) * 2 - 1 for a in accuracy], axis=1)
    posterior, table = personal.estimate_reliabilities(votes, np.ones(len(votes)))
    assert np.mean((posterior > 0.5) == truth) > 0.95
    assert all(abs(table[i, 1, 2] - a) < 0.03 for i, a in enumerate(accuracy))


def items_in(text, items):
    words = regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())
    found = {}
    for item, other in items.items():
        b = regex.findall(r"[\p{L}\p{M}\p{N}]+", (other or "").lower())
        for shift in range(-len(b), len(words)):
            same = sum(0 <= shift + i < len(words) and words[shift + i] == w for i, w in enumerate(b))
            if len(b) >= 5 and same >= 0.8 * len(b):
                found[item] = max(found.get(item, 0), same / len(b))
    return found


def test_contained_items_are_those_of_every_alignment(spark, documents, texts):
    bench = spark.read.parquet(f"{SMALLEST}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    short = {i: t for i, t in items.items() if len(t.split()) <= decontamination.STRETCH}
    rng = random.Random(1)
    more = {}
    for n, (i, t) in enumerate(list(short.items())[:12]):
        words = t.split()
        for at in rng.sample(range(len(words)), max(1, len(words) // 12)):
            words[at] = "changed"
        more[10**6 + n] = "before it " + " ".join(words) + " and after"
    docs = documents.select("doc_id", "text").unionByName(
        spark.createDataFrame(list(more.items()), "doc_id long, text string")
    )
    wanted = bench.filter(bench.item_id.isin(list(short)))
    few = {**{i: t for i, t in list(texts.items())[:12]}, **more}
    expected = {(d, i): s for d, t in few.items() for i, s in items_in(t, short).items()}
    for at_once in (decontamination.SEEDS_AT_ONCE, 700):  # one broadcast, and several
        rows = decontamination.contained_items(docs, wanted, seeds_at_once=at_once).collect()
        found = {(r["doc_id"], r["item_id"]): r["overlap"] for r in rows if r["doc_id"] in few}
        assert found.keys() == expected.keys()
        assert all(abs(found[k] - expected[k]) < 1e-9 for k in found)


def test_compact_windows_are_cartesian_tree_nodes():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(0, 60, 4)
        hashes = rng.integers(0, 2**63, sizes.sum(), dtype=np.uint64)
        ends = np.cumsum(sizes)
        width = int(rng.integers(1, 12))
        found = passages.compact_windows(hashes, ends - sizes, ends, width)
        expected = []
        for start, end in zip(ends - sizes, ends):
            for c in range(start, end):
                left, right = c, c + 1
                while left > start and hashes[left - 1] > hashes[c]:
                    left -= 1
                while right < end and hashes[right] > hashes[c]:
                    right += 1
                if right - left >= width:
                    expected.append((c, left, right))
        assert sorted(zip(*[x.tolist() for x in found])) == sorted(expected)


def test_exactly_repeated_passages_are_found(spark, documents, texts):
    rng = random.Random(8)
    common = " ".join(f"c{rng.randrange(10**6)}" for _ in range(52))
    phrase = " ".join(f"p{rng.randrange(10**6)}" for _ in range(30))
    more = {}
    for i in range(40):
        own = [f"u{rng.randrange(10**9)}" for _ in range(120)]
        middle = common if i < 25 else phrase
        more[10**6 + i] = " ".join([*own[: i + 20], middle, *own[i + 20 :]])
    every = texts | more
    docs = spark.createDataFrame(list(every.items()), "doc_id long, text string")
    rows = passages.repeated_passages(docs).collect()
    words = {i: regex.findall(r"[\p{L}\p{M}\p{N}]+", (t or "").lower()) for i, t in every.items()}
    holders = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - 49):
            holders[tuple(w[k : k + 50])].add(i)
    expected = {i for h in holders.values() if len(h) > 1 for i in h}
    found = {r["doc_id"] for r in rows}
    assert expected <= found
    assert not any(10**6 + i in found for i in range(25, 40))
    covered = {i: (r["start"], r["end"]) for r in rows for i in [r["doc_id"]] if i in more}
    assert all(covered[10**6 + i] == (i + 20, i + 72) for i in range(25))


def test_every_two_texts_that_share_a_passage_are_partners(spark):
    """Also where one word differs, wherever it stands, in texts of which one shares several
    passages, in copies, in rows of one doc_id, and where more share it than are pairs."""
    rng = random.Random(9)

    def unique(n):
        return [f"u{rng.randrange(10**12)}" for _ in range(n)]

    first, second, third, many = (unique(n) for n in (50, 60, 60, 55))
    rows = [(0, unique(30) + first + unique(30))]
    for at in range(5, 45):
        rows.append((at, unique(30) + first[:at] + unique(1) + first[at + 1 :] + unique(30)))
    rows += [(100, second + unique(20) + third), (101, unique(9) + second), (102, second + unique(60) + third)]
    rows += [(103, third), (104, third), (105, third), (106, third + unique(10)), (106, unique(10) + third)]
    for i in range(80):
        rows.append((200 + i, unique(i) + many + unique(5)))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {(r["doc_id"], r["start"], r["end"]): r for r in passages.repeated_passages(docs).collect()}

    assert all((at, 30, 80) in found and found[at, 30, 80]["other_id"] == 0 for at in range(5, 45))
    assert sum(found[0, *ends]["n_partners"] for i, *ends in found if i == 0) == 40
    for row, other, partners in (
        ((100, 0, 60), 101, 2), ((101, 9, 69), 100, 2), ((102, 120, 180), 100, 5), ((103, 0, 60), 100, 5),
        ((105, 0, 60), 100, 5), ((106, 0, 60), 100, 5), ((106, 10, 70), 100, 5),
    ):
        assert (found[row]["other_id"], found[row]["n_partners"]) == (other, partners), row
    for i in range(80):
        row = found[200 + i, i, i + 55]
        assert (row["other_id"], row["n_partners"], row["similarity"]) == (200 + (i == 0), 79, 1.0)


def test_overlapping_passages_are_one_row_with_every_partner_once(spark):
    """Near copies leave a row or two of each text, not one for every partner, also where
    they meet in blocks of a few texts, in which a partner's passages are apart at first."""
    rng = random.Random(10)

    def unique(n):
        return [f"u{rng.randrange(10**12)}" for _ in range(n)]

    left, right = unique(60), unique(60)
    rows = [(0, left + right), (1, left + unique(30) + right), (2, unique(9) + left[-30:] + right[:30])]
    base = unique(300)
    for i in range(90):
        at, size = rng.randrange(60, 200), rng.randrange(1, 40)
        rows.append((100 + i, base[:at] + unique(size) + base[at + size :]))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = {(r["doc_id"], r["start"], r["end"]): r for r in passages.repeated_passages(docs).collect()}

    assert (found[0, 0, 120]["other_id"], found[0, 0, 120]["n_partners"]) == (1, 2)
    assert all(found[1, *ends]["n_partners"] == 1 for ends in ((0, 60), (90, 150)))
    near = {k: r for k, r in found.items() if k[0] >= 100}
    assert len(near) <= 2 * 90
    whole = [r for (_, start, end), r in near.items() if (start, end) == (0, 300)]
    assert whole and all(r["n_partners"] == 89 for r in whole)


def test_shared_passages_are_those_of_plain_python():
    """Also where words repeat, so that shingles stand in a text more than once."""
    rng = random.Random(11)
    for _ in range(40):
        pairs = []
        for _ in range(6):
            base = [rng.randrange(rng.choice((2, 10**9))) for _ in range(rng.randrange(60, 200))]
            other = list(base)
            for _ in range(rng.randrange(4)):
                at, size = rng.randrange(50), rng.randrange(1, 30)
                other[at : at + rng.randrange(2) * size] = rng.choice(([], base[:size], [rng.randrange(10**9)]))
            pairs.append((base, other + base[:40]))
        sides = [[list(zip(*(w[i:] for i in range(5)))) for w in side] for side in zip(*pairs)]
        codes = {s: i for i, s in enumerate({(p, x) for side in sides for p, t in enumerate(side) for x in t})}
        own, others = (
            np.array([codes[p, x] for p, t in enumerate(side) for x in t]) for side in sides
        )
        own_sizes, other_sizes = (np.array([len(t) for t in side]) for side in sides)
        first = np.full(len(codes), -1)
        first[others[::-1]] = np.arange(len(others))[::-1]
        found = passages.shared_passages(
            own, own_sizes, passages._before(own, own_sizes), first[own], passages.Others(others, other_sizes), 0.8, 50
        )
        expected = [(p, *row) for p, (a, b) in enumerate(zip(*sides)) for row in plain_passages(a, b)]
        assert sorted(zip(*(x.tolist() for x in found))) == sorted(expected)


def plain_passages(own, theirs):
    """``start, end, other start, other end, similarity`` of texts given as shingles."""
    where = [theirs.index(x) if x in theirs else None for x in own]
    runs, stretches = [], []
    for i, at in enumerate(where):
        if at is not None and i and where[i - 1] is not None:
            runs[-1][1] = i + 1
        elif at is not None:
            runs.append([i, i + 1])
    for start, end in runs:
        last = stretches[-1] if stretches else None
        if last and sum(e - s for s, e in last) + end - start >= 0.8 * (end - last[0][0]):
            last.append((start, end))
        else:
            stretches.append([(start, end)])
    rows = []
    for stretch in stretches:
        longest = max(stretch, key=lambda r: (r[1] - r[0], -r[0]))
        if stretch[-1][1] - stretch[0][0] < 46:
            continue
        for low, high in ((stretch[0][0], stretch[-1][1]), longest):
            if high - low < 46:
                continue
            spots = [where[i] for i in range(low, high) if where[i] is not None]
            usual = int(np.median([where[i] - i for i in range(low, high) if where[i] is not None]))
            best = (-1.0, 0, 0)
            for begin, end in (
                (low + usual, high + usual), (where[low], where[low] + high - low), (min(spots), max(spots) + 1)
            ):
                begin, end = max(0, begin), min(len(theirs), end)
                a, b = set(own[low:high]), set(theirs[begin:end])
                best = max(best, (len(a & b) / len(a | b), begin, end))
            if best[0] >= 0.8:
                rows.append((low, high + 4, best[1], best[2] + 4, best[0]))
                break
    return rows


def test_passages_have_so_many_words_in_common():
    assert passages.common_words(50, 0.8) == 23
    assert passages.common_words(50, 1.0) == 50


def test_hints_do_not_look_at_case(spark):
    docs = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["write to bob (at) example (dot) com", "WRITE TO BOB (AT) EXAMPLE (DOT) COM"])],
        "doc_id long, text string",
    )
    found = docs.select("doc_id", F.explode(personal.candidates(F.col("text"))).alias("c")).collect()
    assert [(r["doc_id"], r["c"]["kind"]) for r in found] == [(0, "spelled_email"), (1, "spelled_email")]


def test_columns_of_the_user_stay(spark):
    docs = spark.createDataFrame(
        [(1, "mail a@b.co", "mine", "too", "three")], "doc_id long, text string, pii_spans string, pii_candidates string, pii_base string"
    )
    row = personal.redacted(docs).first()
    assert tuple(row) == (1, "mail [EMAIL]", "mine", "too", "three")
