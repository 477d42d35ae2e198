from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fieldtally.llm import quality


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(covered),
    )


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_statistics_are_those_of_plain_python(documents, texts, frame):
    more = ["ha ha ha ha", "a b c\na b c\n\na b c d", "\x0bx\x0c y z | 😀", "", None, "# # #"]
    odd = frame("doc_id long, text string", *[(-i, t) for i, t in enumerate(more, 1)])
    docs = documents.select("doc_id", "text").unionByName(odd)
    every = texts | {-i: t for i, t in enumerate(more, 1)}
    for r in quality.counted_words(docs, "doc_id").collect():
        assert tuple(r[c] for c in COLUMNS) == expected(every[r["doc_id"]])


def test_clean_rows_are_kept_and_outliers_are_not(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "en", " ".join(f"w{x}" for x in rng.integers(0, 5000, int(200 * np.exp(rng.normal(0, 0.4)))))) for i in range(300)]
    rows += [(1000 + i, "en", " ".join(["$$$|||###"] * 3 + [f"v{x}" for x in rng.integers(0, 5000, 60)] ) + " #" * 400) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("source", F.lit("s"))
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(docs, least=50).collect()}
    assert sum(kept[i] for i in range(300)) >= 298
    assert not any(kept[1000 + i] for i in range(9))


def test_estimate_ignores_a_fifth_of_far_rows(spark):
    rng = np.random.default_rng(3)
    clean = rng.normal(0, 1, (800, 5))
    far = rng.normal(12, 0.5, (200, 5))
    rows = [("g", *map(float, x)) for x in np.vstack([clean, far])]
    table = spark.createDataFrame(rows, "cell string, " + ", ".join(f"{c} double" for c in quality.STATISTICS))
    model = quality.fit_mcd(table, "cell").first()
    assert all(abs(model[f"m_{c}"]) < 0.25 for c in quality.STATISTICS)


def test_chi_square_quantile():
    assert abs(quality.chi_square_quantile(0.95, 5) - 11.07) < 0.05
