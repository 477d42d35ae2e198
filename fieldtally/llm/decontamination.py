"""Benchmark decontamination by spaced seeds.

A mask selects some of the token positions in a short window and ignores the
others, so a substituted token inside the window does not hide the match. The
masked windows of all benchmark items are hashed; the documents are streamed past
them once. Around every hit the aligned tokens of document and item are compared,
and an item counts as contained when enough of them agree. Built-in DataFrame
functions only.

The join's small side is the table of benchmark seeds. It is counted first; if it
is beyond ``SEEDS_AT_ONCE`` it is split into pieces below that size, and the
documents are streamed past each piece. Documents are never shuffled: only hits
are, after a partial aggregation by document and item.

Defined results: null or empty texts match nothing; items of fewer than
``SHORTEST`` tokens are not searched, as so few words prove nothing; repeated rows
of one document give one row per item; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.tokens import word_hashes
from fieldtally.sources.staging import stage

#: Masks of six tokens each; a 0 ignores the position.
MASKS = ("1101111", "1110111", "11101011")
SHORTEST = 5
#: Seeds in one broadcast; about 100 bytes each.
SEEDS_AT_ONCE = 500_000
#: Longest stretch compared around a hit.
STRETCH = 50


def _positions(mask: str) -> list[int]:
    return [i for i, bit in enumerate(mask) if bit == "1"]


def _seed(hashes: Column, at: Column, mask: str) -> Column:
    picked = [F.get(hashes, at + step) for step in _positions(mask)]
    fits = at + len(mask) <= F.size(hashes)
    return F.when(fits, F.xxhash64(F.lit(mask), *picked))


def item_seeds(items: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """``seed, item_id, item_at, stretch_at, stretch``: the tokens to compare
    around the seed, which start ``item_at - stretch_at`` tokens before it."""
    tokens = items.select("item_id", word_hashes(F.col("text")).alias("tokens")).filter(
        F.size("tokens") >= SHORTEST
    )
    placed = tokens.select("item_id", "tokens", F.posexplode("tokens").alias("item_at", "_"))
    seeds = placed.select(
        "item_id", "item_at", "tokens",
        F.explode(F.array(*[_seed(F.col("tokens"), F.col("item_at"), m) for m in masks])).alias("seed"),
    ).filter(F.col("seed").isNotNull())
    length = F.least(F.size("tokens"), F.lit(STRETCH))
    first = F.greatest(
        F.lit(0), F.least(F.col("item_at") - STRETCH // 2, F.size("tokens") - length)
    )
    return seeds.select(
        "seed", "item_id", "item_at", first.alias("stretch_at"),
        F.slice("tokens", first + 1, length).alias("stretch"),
    )


def _masks_for(items: DataFrame) -> tuple[str, ...]:
    """The fixed masks, and a plain one for each item length below their span."""
    widest = max(map(len, MASKS))
    short = (
        items.select(F.size(word_hashes(F.col("text"))).alias("n"))
        .filter((F.col("n") >= SHORTEST) & (F.col("n") < widest))
        .distinct().collect()  # at most widest - SHORTEST rows
    )
    return (*MASKS, *sorted("1" * r["n"] for r in short))


def contained_items(
    docs: DataFrame, items: DataFrame, share: float = 0.8, seeds_at_once: int = SEEDS_AT_ONCE
) -> DataFrame:
    """Pairs ``doc_id, item_id`` with ``overlap`` (largest share of aligned tokens
    that agree in a stretch of the item), ``start`` (first word of such a stretch
    in the document) and ``n_hits``; only pairs whose overlap is at least
    ``share``. ``items`` has ``item_id`` and ``text``."""
    masks = _masks_for(items)
    seeds = stage(item_seeds(items.select("item_id", "text"), masks), "seeds")
    pieces = -(-max(1, seeds.count()) // seeds_at_once)
    tokens = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), word_hashes(F.col("text")).alias("doc_tokens")
    )
    placed = tokens.select("doc_id", "doc_tokens", F.posexplode("doc_tokens").alias("at", "_"))
    hashed = placed.select(
        "doc_id", "doc_tokens", "at",
        F.explode(F.array(*[_seed(F.col("doc_tokens"), F.col("at"), m) for m in masks])).alias("seed"),
    )
    found = []
    for piece in range(pieces):
        part = seeds if pieces == 1 else seeds.filter(
            F.pmod(F.xxhash64("seed", "item_id", "item_at"), F.lit(pieces)) == piece
        )
        found.append(_agreeing(hashed.join(F.broadcast(part), "seed")))
    agrees = F.col("overlap") >= share
    # Filtering before the aggregation would be moved into the join's condition and
    # take the exploded rows out of generated code.
    return (
        reduce(DataFrame.unionByName, found)
        .groupBy("doc_id", "item_id")
        .agg(
            F.max("overlap").alias("overlap"),
            F.min(F.when(agrees, F.col("start"))).alias("start"),
            F.sum(agrees.cast("long")).alias("n_hits"),
        )
        .filter(F.col("overlap") >= share)
    )


def _agreeing(hits: DataFrame) -> DataFrame:
    """Share of the item's stretch that agrees with the aligned document tokens."""
    start = F.col("at") - F.col("item_at") + F.col("stretch_at")
    before = F.greatest(-start, F.lit(0))  # tokens of the stretch before the document
    there = F.slice("doc_tokens", F.greatest(start, F.lit(0)) + 1, F.size("stretch") - before)
    aligned = hits.select(
        "doc_id", "item_id", F.greatest(start, F.lit(0)).alias("start"), there.alias("there"),
        F.slice("stretch", before + 1, F.size("stretch")).alias("mine"),
        F.size("stretch").alias("length"),
    )
    equal = F.zip_with("there", "mine", lambda a, b: a == b)
    agreeing = F.size(F.filter(equal, lambda same: same)) / F.col("length")
    return aligned.select(
        "doc_id", "item_id", "start",
        F.when(F.size("there") > 0, agreeing).otherwise(0.0).alias("overlap"),
    )


def op5_spaced_seeds(spark, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, one row per document and item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contained_items(docs, items)
