"""The toxicity classifier: grams and ratios against brute force, held-out accuracy."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldtally.llm import toxicity

INSULTS = ("dunderhead", "nitwit", "blockhead")


def _grams(text):
    folded = " " + " ".join(text.lower().split()) + " "
    return {folded[i : i + n] for n in toxicity.ORDERS for i in range(len(folded) - n + 1)}


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words = ["".join(rng.choices("aeioulnrst", k=rng.randint(2, 7))) for _ in range(rng.randint(5, 120))]
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_distinct_buckets_stand_for_distinct_grams():
    texts = ["Abc  abc\tABC", "", None, "x", "äöü 😀 äöü", "the quick brown fox " * 50]
    found = [f.tolist() for f in toxicity.Grams().of(texts)]
    for text, buckets in zip(texts, found):
        assert len(buckets) == len(set(buckets)) == len(_grams(text or "") if text else [])
    apart = [f.tolist() for t in texts for f in toxicity.Grams().of([t])]
    assert found == apart


def test_long_text_equals_its_parts_in_any_batch():
    long = " ".join(f"word{i % 700}" for i in range(200_000))
    (found,) = toxicity.Grams().of([long])
    assert len(found) <= len(_grams(long))  # buckets may be shared
    assert len(found) > 0.99 * len(_grams(long))


def _bucket(gram):
    letters = toxicity.mix(np.array([ord(c) for c in gram], dtype=np.uint64) + toxicity._STEP)
    (found,) = toxicity._buckets(letters)[len(gram) - min(toxicity.ORDERS)]
    return int(found)


def test_ratios_against_brute_force(spark, marked):
    docs, labels = marked
    texts = {r.doc_id: r.text for r in docs.collect()}
    counts = [Counter(), Counter()]
    for row in labels.collect():
        counts[row.toxic].update({_bucket(g) for g in _grams(texts[row.doc_id])})
    rows = (
        docs.join(labels, "doc_id").select("toxic", "text")
        .mapInArrow(toxicity._count, "bucket long, clean long, toxic long")
        .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    ratios = toxicity.log_count_ratios(rows)
    kept = {b for c in counts for b in c if counts[0][b] + counts[1][b] >= toxicity.LEAST_DOCUMENTS}
    sums = [sum(counts[c][b] + toxicity.SMOOTHING for b in kept) for c in (0, 1)]
    for bucket in kept:
        ratio = math.log((counts[1][bucket] + toxicity.SMOOTHING) / sums[1]) - math.log(
            (counts[0][bucket] + toxicity.SMOOTHING) / sums[0]
        )
        assert ratios[bucket] == pytest.approx(ratio if abs(ratio) >= toxicity.LEAST_RATIO else 0, abs=1e-5)
    assert set(np.flatnonzero(ratios).tolist()) <= kept


def test_regression_reaches_a_minimum():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 30, 8)).astype(np.int32) for _ in range(200)]
    labels = np.array([float(3 in r or rng.random() < 0.1) for r in rows])
    scale = rng.normal(size=32)
    weights, intercept = toxicity.logistic(rows, labels, scale)
    balance = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum()) * len(rows)
    x = np.zeros((200, 32))
    for i, r in enumerate(rows):
        x[i, r] = scale[r]
    inner = np.where(scale != 0, weights / scale, 0)
    slope = x.T @ (balance * (1 / (1 + np.exp(-(x @ inner + intercept))) - labels)) + toxicity.PENALTY * inner
    used = np.unique(np.concatenate(rows))
    assert np.abs(slope[used]).max() < 0.05


def test_held_out_rows_are_found(marked):
    docs, labels = marked
    apart = labels.filter(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, apart)
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_a_smaller_sample_still_learns(marked):
    docs, labels = marked
    model = toxicity.fit(docs, labels, sample=40)
    rows = toxicity.score(docs, model).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9


def test_labels_and_ids_do_not_enter_a_score(spark, marked):
    docs, labels = marked
    model = toxicity.fit(docs, labels)
    first = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    moved = docs.withColumn("doc_id", F.col("doc_id") + 10_000)
    assert {r.doc_id - 10_000: r.score for r in toxicity.score(moved, model).collect()} == first


def test_odd_and_empty_rows(spark, odd, empty):
    labels = spark.createDataFrame(
        [(1, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (7, 0, None), (9, 1, 1), (10, 1, 3)],
        "doc_id long, quality int, toxic int",
    )
    model = toxicity.fit(odd, labels)
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(blank) == 1
    assert toxicity.score(empty, model).count() == 0
    for none in (labels.limit(0), labels.filter("toxic = 1")):
        flat = toxicity.score(odd, toxicity.fit(odd, none)).collect()
        assert len({r.score for r in flat}) == 1
    assert toxicity.score(odd, toxicity.fit(empty, labels)).count() == odd.count()
