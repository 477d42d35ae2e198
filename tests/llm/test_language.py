from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from fieldtally.llm import language


def test_held_out_documents_are_recognised(documents):
    found = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out").collect()
    assert len(held) > 20
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.95
    assert not any(r["rejected"] for r in held) and all(0 <= r["score"] <= 1 for r in held)


def test_noise_is_rejected(spark, documents):
    rng = np.random.default_rng(0)
    noise = ["".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 300)) for _ in range(5)]
    rows = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(noise)], "doc_id long, text string")
    docs = documents.select("doc_id", "text", "lang").unionByName(rows, allowMissingColumns=True)
    found = language.identify(docs).filter("doc_id >= 1000000").collect()
    assert all(r["rejected"] for r in found)


def test_probabilities_are_those_of_plain_counting(spark):
    text = "abab abba abac babab"
    docs = spark.createDataFrame([("xx", text)], "lang string, text string")
    model = language.train(docs, grams=10**6)["xx"]
    codes = [ord(c) & 0xFFFF for c in "   " + text]
    grams = {4: Counter(tuple(codes[i : i + 4]) for i in range(len(text)))}
    for order in (3, 2, 1):
        grams[order] = Counter(g[1:] for g in grams[order + 1])
    alphabet = len(grams[1]) + 1

    def probability(gram):
        order = len(gram)
        if order == 0:
            return 1 / alphabet
        counts = grams[order]
        ones, twos = (sum(n == k for n in counts.values()) for k in (1, 2))
        discount = max(0.1, min(0.95, ones / (ones + 2 * twos))) if ones + 2 * twos else 0.5
        mine = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        total = sum(mine.values())
        if not total:
            return probability(gram[1:])
        return max(mine.get(gram, 0) - discount, 0) / total + discount * len(mine) / total * probability(gram[1:])

    packed, lengths = language.windows([text])
    assert lengths.tolist() == [len(text)]
    found = model.log_probabilities(packed)
    for i, value in enumerate(found):
        assert math.isclose(value, math.log(probability(tuple(codes[i : i + 4]))), abs_tol=1e-9)


def test_languages_beyond_one_round_are_learned(spark):
    """Seventy languages of letters of their own: each text is told by its language,
    and rounds of a few find what one round finds."""
    rng = np.random.default_rng(3)
    rows = []
    for n in range(70):
        letters = [chr(0x4E00 + 20 * n + k) for k in range(8)]
        rows += [(n * 8 + i, "".join(rng.choice(letters, 60)), f"l{n:02}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = [
        {r["doc_id"]: tuple(r) for r in language.identify(docs, languages=most).collect()} for most in (64, 9)
    ]
    assert found[0] == found[1]
    assert all(found[0][i][2] == name for i, _, name in rows)


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(50).select(F.col("id").alias("doc_id")).withColumn("out", language.held_out()).collect()
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
