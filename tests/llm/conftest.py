from __future__ import annotations

import pytest

SMALLEST = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Extra columns named like those the operators use inside.
    "label string, node string, key string, words string, tokens string, shard string, slot string, "
    "seed string, best string, hashes string, band string, cell string, distance string, "
    "ids string, sample string, pii_spans string, entropy string, file string, pivot string"
)
EXTRA = ("x",) * 19

LONG = " ".join(f"wort{i % 977} and the {i % 31}" for i in range(3_000))
TEXTS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, "   \n\t ", None, None), (4, "!!! ###", "de", "b"),
    (5, "one", "en", None), (6, "one two three four", None, "b"), (7, LONG, "en", "a"),
    (8, LONG, "en", "a"), (9, "same words here again and more", "en", "a"),
    (9, "same words here again and more", "en", "a"), (None, "nobody has this text at all", "fr", "a"),
    (None, None, None, None), (10, "mail a@b.co call +1 555 123 4567 日本語 😀", "en", "b"),
]


@pytest.fixture(scope="package", autouse=True)
def few_partitions(spark):
    """These tables are tiny, and the operators run many small stages."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeats, clashing names."""
    rows = [(i, t, lang, s, None if t is None else len(t), *EXTRA) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALLEST}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.select("doc_id", "text").collect()}
