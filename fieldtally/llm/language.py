"""Language identification with interpolated Kneser-Ney character models.

Training counts the four-character windows of all labelled texts: workers count
distinct windows batch by batch, Spark adds the counts. Lower orders, discounts,
probabilities and back-off weights follow from that table by joins and
aggregations of Spark; their size is that of the distinct windows, not that of the
corpus. The model of a language is a set of sorted arrays of window codes with
their log-probabilities; at most ``grams`` windows of each order and language are
kept, the most frequent ones. Every learned language has a model. Models come to the
driver, and go to the workers, for so many languages at a time as the parameters say; each
round leaves every text with the best two languages so far, so memory is bounded by the
parameters whatever the number of languages.

A text goes to the language of lowest cross-entropy per character. Rejection is
calibrated on the training texts: each language has the cross-entropy that all but
``tail`` of its own texts stay below, with an allowance in nats per character and a wider one
for short texts: text of the learned languages passes even where it holds much that
was never seen, noise does not.

Characters are lower-cased; runs of anything but letters become one space; codes
are folded to 16 bits. Defined results: a null text, or one without a letter, is
``und`` with score 0 and rejected; texts without language, or with a null doc_id,
are not learned from; without any training text all documents are ``und``. Extra
columns are ignored; repeated rows count as often as they occur.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldtally.llm.batches import code_points, in_chunks
from fieldtally.sources.staging import stage, stage_in_batches, unstage

ORDER = 4
UNDETERMINED = "und"
#: Characters worked on at once in a worker.
CHUNK = 250_000
#: Texts on their way to a worker at once.
BATCH_ROWS = 1_000
#: What a round of languages leaves of a text.
ROUND = {"best": "string", "entropy": "double", "second": "double", "length": "long"}
#: Columns of the documents; the text goes on to the next round only.
KNOWN = ["doc_id long", "held_out boolean", "learned boolean", "lang string", "text string"]


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its 16-bit code, or a space if it is no letter."""
    codes = np.full(0x110000, 32, dtype=np.uint64)
    found = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == "L"]
    codes[found] = np.array(found, dtype=np.uint64) & np.uint64(0xFFFF)
    return codes


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the windows of all texts, and how many each text has: one for each
    kept character, which is the last of its window."""
    pad = " " * (ORDER - 1)
    points, lengths = code_points([pad + text.lower() for text in texts])
    codes = _letters()[points]
    owner = np.repeat(np.arange(len(texts)), lengths)
    starts = np.cumsum(lengths) - lengths
    inside = np.arange(len(codes)) - starts[owner]
    blank = codes == 32
    repeated = np.zeros(len(codes), dtype=bool)
    repeated[1:] = blank[1:] & blank[:-1]
    keep = ~repeated | (inside < ORDER - 1)
    codes, owner, inside = codes[keep], owner[keep], inside[keep]
    if len(codes) < ORDER:
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    packed = codes[ORDER - 1 :].copy()
    for back in range(1, ORDER):
        packed |= codes[ORDER - 1 - back : len(codes) - back] << np.uint64(16 * back)
    own = inside[ORDER - 1 :] >= ORDER - 1
    return packed[own].view(np.int64), np.bincount(owner[ORDER - 1 :][own], minlength=len(texts))


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = batch.to_pandas()
        for language, group in table.groupby("lang"):
            for texts in in_chunks(group["text"].tolist(), CHUNK):
                packed, _ = windows(texts)
                places, distinct = pd.factorize(packed)
                yield pa.RecordBatch.from_pydict(
                    {
                        "lang": pa.array([language] * len(distinct), pa.string()),
                        "gram": pa.array(distinct, pa.int64()),
                        "n": pa.array(np.bincount(places, minlength=len(distinct)), pa.int64()),
                    }
                )


def count_windows(labelled: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all texts."""
    return (
        labelled.select("lang", "text").filter("lang is not null and text is not null")
        .mapInArrow(_count_windows, "lang string, gram long, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )


def _discounts(grams: DataFrame) -> DataFrame:
    once, twice = (F.sum((F.col("n") == k).cast("long")) for k in (1, 2))
    return grams.groupBy("lang").agg(
        F.coalesce(
            F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.try_divide(once, once + 2 * twice))),
            F.lit(0.5),
        ).alias("discount")
    )


def estimate(counts: DataFrame, grams: int) -> tuple[DataFrame, DataFrame]:
    """``(order, lang, gram, log_p)`` and ``(order, lang, context, log_back_off)``.
    The highest order uses the counts, lower ones the number of distinct
    characters before the window."""
    levels = {ORDER: stage_in_batches(counts, "grams", BATCH_ROWS)}
    for order in range(ORDER - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * order) - 1))
        levels[order] = stage(
            levels[order + 1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n")),
            "grams",
        )
    alphabet = levels[1].select("gram").distinct().count() + 1
    probabilities, weights, lower = [], [], None
    for order in range(1, ORDER + 1):
        table = levels[order].withColumn("context", F.shiftrightunsigned("gram", 16))
        if order == 1:
            table = table.withColumn("context", F.lit(0).cast("long"))
        contexts = table.groupBy("lang", "context").agg(
            F.sum("n").alias("total"), F.count("*").alias("kinds")
        ).join(_discounts(table), "lang").withColumn(
            "back_off", F.col("discount") * F.col("kinds") / F.col("total")
        )
        contexts = stage(contexts, "contexts")
        rows = table.join(contexts, ["lang", "context"])
        own = F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")
        if order == 1:
            p = own + F.col("back_off") / F.lit(alphabet)
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))
            rows = rows.withColumn("shorter", suffix).join(
                lower.withColumnsRenamed({"gram": "shorter", "p": "shorter_p"}), ["lang", "shorter"]
            )
            p = own + F.col("back_off") * F.col("shorter_p")
        level = stage(rows.select("lang", "gram", "n", p.alias("p")), "probabilities")
        lower = level.select("lang", "gram", "p")
        probabilities.append(level.withColumn("order", F.lit(order)))
        weights.append(contexts.withColumn("order", F.lit(order)))
    # All orders in one table, so that one plan finds the frequent ones.
    best = _most_frequent(_together(probabilities), "n", grams)
    frequent = _most_frequent(_together(weights), "total", grams)
    return (
        best.select("order", "lang", "gram", F.log("p").alias("log_p")),
        frequent.select("order", "lang", "context", F.log("back_off").alias("log_back_off")),
    )


def _together(tables: list[DataFrame]) -> DataFrame:
    first, *rest = tables
    for table in rest:
        first = first.unionByName(table)
    return first


def _most_frequent(table: DataFrame, count: str, most: int) -> DataFrame:
    """Rows of each order and language with a count so high that at most ``most`` rows
    have such a count (all rows where fewer exist)."""
    keys = ["order", "lang"]
    sizes = table.groupBy(*keys, F.col(count).alias("at")).agg(F.count("*").alias("rows"))
    down = Window.partitionBy(*keys).orderBy(F.desc("at"))
    reached = sizes.withColumn("reached", F.sum("rows").over(down)).filter(F.col("reached") <= most)
    least = reached.groupBy(*keys).agg(F.min("at").alias("least"))
    return table.join(least, keys).filter(F.col(count) >= F.col("least"))


@dataclass(frozen=True)
class LanguageModel:
    """Sorted window codes with log-probabilities, and sorted contexts with
    back-off weights, by order; ``unknown`` is the log-probability of a character
    never seen."""

    grams: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]
    unknown: float

    def log_probabilities(self, packed: np.ndarray) -> np.ndarray:
        """Of the last character of each window given those before it."""
        result = np.zeros(len(packed))
        left = np.arange(len(packed))
        for order in range(ORDER, 0, -1):
            key = (packed[left].view(np.uint64) & np.uint64((1 << 16 * order) - 1)).view(np.int64)
            value, found = _look_up(self.grams[order], key)
            result[left[found]] += value[found]
            left, key = left[~found], key[~found]
            if order > 1:
                context = (key.view(np.uint64) >> np.uint64(16)).view(np.int64)
                weight, known = _look_up(self.contexts[order], context)
                result[left[known]] += weight[known]
        result[left] += self.unknown
        return result


def _look_up(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray):
    codes, values = table
    if not len(codes):
        return np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(codes, keys), len(codes) - 1)
    return values[at], codes[at] == keys


def train_in_rounds(
    labelled: DataFrame, grams: int = 40_000, languages: int = 64
) -> Iterator[tuple[dict[str, LanguageModel], bool]]:
    """Models of all languages in their order, at most ``languages`` at a time, and whether
    they are the last. What comes to the driver at once has at most ``2 * ORDER * grams``
    rows for each of these."""
    probabilities, weights = (stage(t, "model") for t in estimate(count_windows(labelled), grams))
    names = probabilities.select("lang").distinct()
    after, last = names, False
    while not last:
        found = [r["lang"] for r in after.orderBy("lang").limit(languages + 1).collect()]
        chosen, last = found[:languages], len(found) <= languages
        if chosen:
            after = names.filter(F.col("lang") > chosen[-1])
            p, w = (t.filter(F.col("lang").isin(chosen)).toArrow().to_pandas() for t in (probabilities, weights))
            yield _models(chosen, p, w), last


def train(labelled: DataFrame, grams: int = 40_000) -> dict[str, LanguageModel]:
    """The models of all languages together."""
    models = {}
    for some, _ in train_in_rounds(labelled, grams):
        models |= some
    return models


def _models(chosen: list[str], p: pd.DataFrame, w: pd.DataFrame) -> dict[str, LanguageModel]:
    models = {}
    for language in sorted(chosen):
        mine, back = p[p["lang"] == language], w[w["lang"] == language]
        grams_of = {o: _sorted(mine[mine["order"] == o], "gram", "log_p") for o in range(1, ORDER + 1)}
        floor = grams_of[1][1].min() if len(grams_of[1][1]) else -12.0
        models[language] = LanguageModel(
            grams_of,
            {o: _sorted(back[back["order"] == o], "context", "log_back_off") for o in range(1, ORDER + 1)},
            float(floor) - 2.0,
        )
    return models


def _sorted(table: pd.DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    codes = table[key].to_numpy(np.int64)
    order = np.argsort(codes)
    return codes[order], table[value].to_numpy(float)[order]


def entropies(texts: list[str], models: dict[str, LanguageModel]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character (texts by models), and characters of each text.
    Every distinct window is looked up once."""
    packed, lengths = windows(texts)
    places, distinct = pd.factorize(packed)
    sums = np.zeros((len(texts), len(models)))
    filled = np.flatnonzero(lengths)
    starts = (np.cumsum(lengths) - lengths)[filled]
    for column, model in enumerate(models.values()):
        if len(filled):
            values = model.log_probabilities(distinct)[places]
            sums[filled, column] = np.add.reduceat(values, starts)
    return -sums / np.maximum(lengths, 1)[:, None], lengths


def _scorer(models, kept: int):
    """Scores texts with some languages, beside the ``best`` and its ``entropy`` and
    ``second`` entropy of the languages before (nulls at first). The first ``kept`` columns
    are handed on."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*models.value, None], dtype=object)
        for batch in batches:
            table = batch.to_pandas()
            earlier = table["best"].to_numpy(object)
            before = table[["entropy", "second"]].fillna(np.inf).to_numpy(float)
            best, two, length, done = [], [], [], 0
            for texts in in_chunks([t or "" for t in table["text"]], CHUNK):
                values, lengths = entropies(texts, models.value)
                lettered = np.array([any(map(str.isalpha, t)) for t in texts]) & (lengths > 0)
                part = slice(done, done + len(texts))
                done += len(texts)
                # A language of a round before comes first where entropies are equal.
                every = np.concatenate([before[part], values], axis=1)
                order = np.argsort(every, axis=1, kind="stable")
                winner = order[:, 0]
                name = np.where(winner < 2, earlier[part], names[np.maximum(winner, 2) - 2])
                best += np.where(lettered, name, UNDETERMINED).tolist()
                two.append(np.take_along_axis(every, order[:, :2], axis=1))
                length += np.where(lettered, lengths, 0).tolist()
            two = np.concatenate(two) if two else np.zeros((0, 2))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(kept)), pa.array(best, pa.string()),
                    *(pa.array(two[:, i], pa.float64()) for i in (0, 1)), pa.array(length, pa.int64()),
                ],
                [*batch.schema.names[:kept], *ROUND],
            )

    return score


def held_out(doc_id: str = "doc_id") -> Column:
    fourth = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    return F.coalesce(fourth == 2, F.lit(False))


def identify(
    docs: DataFrame, grams: int = 40_000, tail: float = 0.001, allowance: float = 1.0, languages: int = 64
) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score`` (0 to 1, from
    the margin to the next language and the length), ``entropy`` and ``rejected``."""
    spark = docs.sparkSession
    known = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
        (~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull()).alias("learned"),
        "lang", "text",
    )
    table = known.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in ROUND.items()])
    scored = None
    for models, last in train_in_rounds(known.filter("learned"), grams, languages):
        handed = KNOWN[:-1] if last else KNOWN
        schema = ", ".join([*handed, *(f"{name} {kind}" for name, kind in ROUND.items())])
        score = _scorer(spark.sparkContext.broadcast(models), len(handed))
        found = (scored or table).mapInArrow(score, schema)
        earlier, scored = scored, stage_in_batches(found, "languages", BATCH_ROWS)
        if earlier:
            unstage(spark, earlier)
    if scored is None:
        return known.select(
            "doc_id", "held_out", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("entropy"), F.lit(True).alias("rejected"),
        )
    # Beside one language alone, the next one counts as one nat away.
    second = F.when(F.col("second") == float("inf"), F.col("entropy") + 1).otherwise(F.col("second"))
    scored = scored.withColumn("margin", second - F.col("entropy"))
    limits = scored.filter("learned and best = lang").groupBy("best").agg(
        F.percentile_approx("entropy", 1 - tail, 2000).alias("limit")
    )
    decided = scored.join(limits, "best", "left")
    length = F.greatest(F.col("length"), F.lit(1)).cast("double")
    lettered = F.col("length") > 0
    certain = 1 / (1 + F.exp(-F.least(10 * F.col("margin") * F.sqrt(length), F.lit(50.0))))
    return decided.select(
        "doc_id", "held_out", F.col("best").alias("lang_pred"),
        F.when(lettered, certain).otherwise(0.0).alias("score"),
        F.when(lettered, F.col("entropy")).alias("entropy"),
        (~lettered | (F.col("entropy") > F.coalesce("limit", F.lit(3.0)) + allowance + 4 / F.sqrt(length))).alias("rejected"),
    )


def op6_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
