from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import regex

from fieldtally.llm import dartminhash as d
from fieldtally.sources import staging


def brute_classes(texts, threshold=0.8):
    sets = {}
    for i, text in texts.items():
        w = regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    holders = defaultdict(list)
    for i, c in sets.items():
        for s in c:
            holders[s].append(i)
    low = {i: i for i in texts}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    pairs = {p for h in holders.values() for p in itertools.combinations(sorted(h), 2)}
    for a, b in pairs:
        both = sum((sets[a] & sets[b]).values())
        if both >= threshold * (sum(sets[a].values()) + sum(sets[b].values()) - both):
            x, y = root(a), root(b)
            low[max(x, y)] = min(x, y)
    return {i: root(i) for i in texts}


def test_classes_are_those_of_all_pairs(documents, texts):
    found = {r["doc_id"]: r["class_id"] for r in d.near_duplicates(documents).collect()}
    assert found == brute_classes(texts)


def test_large_families_of_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = {}
    for i in range(120):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    for i in range(120, 160):
        texts[i] = " ".join(f"y{rng.randrange(10**6)}" for _ in range(150))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: r["class_id"] for r in d.near_duplicates(docs).collect()}
    assert found == brute_classes(texts)


def test_every_link_of_a_band_is_found(spark, monkeypatch):
    """Near copies of one text: all pairs above the threshold are links, by pairs and by blocks."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    words = []
    for i in range(70):
        copy = list(base)
        copy[rng.randrange(300)] = f"x{i}"
        words.append(copy)
    sets = [{tuple(w[k : k + 5]) for k in range(296)} for w in words]
    expected = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    for few, block in ((10**6, 128), (8, 16)):
        monkeypatch.setattr(d, "IN_PAIRS", few)
        monkeypatch.setattr(d, "BLOCK", block)
        found = {r["doc_id"]: r["n_links"] for r in d.near_duplicates(docs).collect()}
        assert found == dict(enumerate(expected))


def test_signatures_agree_as_often_as_weighted_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300, dtype=np.uint64)
    b = a.copy()
    b[:60] = rng.integers(0, 2**63, 60, dtype=np.uint64)
    weights = rng.choice([0.4, 1.0, 2.5, 6.0], 300)
    owner = np.repeat([0, 1], 300)
    found = d.signatures(owner, np.append(a, b), np.append(weights, weights), 2, 4096)
    same = weights[60:].sum()
    expected = same / (2 * weights.sum() - same)
    assert abs((found[0] == found[1]).mean() - expected) < 0.03


def test_components(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8)], "x long, pivot long")
    found = {r["node"]: r["label"] for r in d.components(links).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_texts_go_to_workers_in_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    counted = staging.stage_in_batches(spark.range(0, 100, 1, 2).mapInArrow(sizes, "n long"), "sizes", 8)
    found = [r["n"] for r in counted.collect()]
    assert sum(found) == 100 and max(found) == 8
    assert spark.conf.get(key) == before
