"""Toxicity: a linear classifier over character n-grams whose features are scaled by
the log-count ratios of naive Bayes.

A text is lower-cased, its white space folded, and every run of 3 to 5 of its
characters hashed to one of ``2 ** BITS`` buckets; only presence counts. Bucket
counts of both classes come from all labelled training documents (each task adds up
its own, a bucket is then one key). The logistic regression on the scaled buckets is
fitted on a sample of about ``sample`` documents of each class, drawn by a hash of
doc_id; the intercept is moved back to the shares of the classes among all training
documents. The model is ``2 ** BITS`` numbers whatever the corpus, every document is
scored on its whole text and no text is shuffled unless the labels outgrow a broadcast.

Defined results: null and empty texts get the score of the intercept alone; a
document labelled twice counts once under each label; rows with a null doc_id are
scored and never learnt from; repeated rows are scored each; without labels of both
classes all scores are the smoothed share of toxic labels; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.batches import code_points, in_chunks, mix

ORDERS = (3, 4, 5)
#: Buckets of hashed n-grams: the model has two raised to this many weights.
BITS = 20
#: Texts worked on at once in a task, in characters; a longer text is worked on alone.
CHUNK = 1_000_000
#: Training labels (16 bytes each) that may be broadcast to the documents.
LABELS_AT_ONCE = 1_000_000
#: Documents that hold a bucket before it may carry weight.
LEAST_DOCUMENTS = 3
#: Buckets whose log-count ratio is nearer to zero say next to nothing and stay out.
LEAST_RATIO = 0.5
SMOOTHING = 1.0
PENALTY = 1.0
STEPS = 60

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)
_SPACE = re.compile(r"\s+")


class Grams:
    """Distinct buckets of texts; one table serves all texts of a task."""

    def __init__(self) -> None:
        self.last = np.zeros(1 << BITS, dtype=np.int32)

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The distinct buckets of each text."""
        for chunk in in_chunks([_folded(t) for t in texts], CHUNK):
            points, lengths = code_points(chunk)
            letters = mix(points.astype(np.uint64) + _STEP)
            orders = _buckets(letters)
            end = 0
            for length in lengths.tolist():
                start, end = end, end + length
                runs = [b[start : end - n + 1] for b, n in zip(orders, ORDERS) if length >= n]
                yield self._distinct(np.concatenate(runs)) if runs else np.zeros(0, dtype=np.int32)

    def _distinct(self, buckets: np.ndarray) -> np.ndarray:
        places = np.arange(len(buckets), dtype=np.int32)
        self.last[buckets] = places
        return buckets[self.last[buckets] == places]


def _folded(text: str | None) -> str:
    return " " + _SPACE.sub(" ", (text or "").lower()).strip() + " "


def _buckets(letters: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the run of so many letters from each place on."""
    found, hashes = [], np.zeros(len(letters), dtype=np.uint64)
    for k in range(max(ORDERS)):
        hashes = hashes[: max(len(letters) - k, 0)] * _STEP
        hashes += letters[k:]
        if k + 1 in ORDERS:
            spread = hashes ^ (hashes >> np.uint64(32))
            spread *= _SPREAD
            spread >>= np.uint64(64 - BITS)
            found.append(spread.astype(np.int32))
    return found


@dataclass(frozen=True)
class Model:
    """Weights of buckets, already times their log-count ratios."""

    weights: bytes
    intercept: float

    def scores(self, grams: Grams, texts: list[str | None]) -> np.ndarray:
        weights = np.frombuffer(self.weights, dtype=np.float32)
        sums = [weights[found].sum(dtype=np.float64) for found in grams.of(texts)]
        return 1 / (1 + np.exp(-np.clip(np.array(sums) + self.intercept, -500, 500)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, text) to the number of documents of each class in each bucket."""
    grams, counts = Grams(), np.zeros((2, 1 << BITS), dtype=np.int64)
    for batch in batches:
        for toxic, found in zip(batch.column(0).to_pylist(), grams.of(batch.column(1).to_pylist())):
            counts[toxic, found] += 1
    used = np.flatnonzero(counts.sum(axis=0))
    for part in np.array_split(used, len(used) // 65_536 + 1):
        yield pa.RecordBatch.from_arrays(
            [pa.array(part), pa.array(counts[0, part]), pa.array(counts[1, part])],
            ["bucket", "clean", "toxic"],
        )


def log_count_ratios(counts: DataFrame) -> np.ndarray:
    """Naive Bayes' log-count ratio of every bucket, 0 for rare and for even ones.
    ``counts`` has at most one row per bucket, so its size does not depend on the corpus."""
    found = counts.filter(F.col("clean") + F.col("toxic") >= LEAST_DOCUMENTS).toPandas()
    shares = [found[c].to_numpy() + SMOOTHING for c in ("toxic", "clean")]
    ratios = np.zeros(1 << BITS, dtype=np.float32)
    ratios[found["bucket"].to_numpy()] = np.log(shares[0] / shares[0].sum()) - np.log(
        shares[1] / shares[1].sum()
    )
    ratios[np.abs(ratios) < LEAST_RATIO] = 0
    return ratios


def _fit(ratios: bytes):
    """Logistic regression on a sample (toxic, text) that one task holds."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.frombuffer(ratios, dtype=np.float32).astype(np.float64)
        grams, rows, labels = Grams(), [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            rows += [f[scale[f] != 0] for f in grams.of(batch.column(1).to_pylist())]
        weights, intercept = logistic(rows, np.array(labels, dtype=np.float64), scale)
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.astype(np.float32).tobytes()]), pa.array([intercept])],
            ["weights", "intercept"],
        )

    return fit


def logistic(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of buckets (times their scale) and intercept with the least penalised
    loss, both classes weighing the same, by limited-memory quasi-Newton steps."""
    counts = np.array([len(r) for r in rows], dtype=np.int64)
    every = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int32)
    used, at = np.unique(every, return_inverse=True)
    owner, factor = np.repeat(np.arange(len(rows)), counts), scale[used]
    weight = np.where(labels == 1, 0.5 / max(labels.sum(), 1), 0.5 / max((1 - labels).sum(), 1)) * len(rows)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        margins = np.bincount(owner, weights=(x[:-1] * factor)[at], minlength=len(rows)) + x[-1]
        value = (weight * (np.logaddexp(0, margins) - labels * margins)).sum()
        errors = weight * (1 / (1 + np.exp(-np.clip(margins, -500, 500))) - labels)
        slope = np.bincount(at, weights=errors[owner], minlength=len(used)) * factor
        penalised = np.append(x[:-1], 0)
        return value + PENALTY / 2 * (penalised @ penalised), np.append(slope, errors.sum()) + PENALTY * penalised

    x = quasi_newton(loss, np.zeros(len(used) + 1))
    weights = np.zeros(len(scale))
    weights[used] = x[:-1] * factor
    return weights, float(x[-1])


def quasi_newton(loss, x: np.ndarray, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halved steps, at most ``STEPS`` of them."""
    value, slope = loss(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(STEPS):
        step, shares = -slope, []
        for s, y in reversed(pairs):
            share = (s @ step) / (s @ y)
            shares.append(share)
            step = step - share * y
        if pairs:
            s, y = pairs[-1]
            step = step * ((s @ y) / (y @ y))
        for (s, y), share in zip(pairs, reversed(shares)):
            step = step + (share - (y @ step) / (s @ y)) * s
        size, fall = 1.0 if pairs else 1 / max(np.abs(slope).sum(), 1), step @ slope
        while True:
            there = x + size * step
            now, steep = loss(there)
            if now <= value + 1e-4 * size * fall or size < 1e-10:
                break
            size /= 2
        if (there - x) @ (steep - slope) > 1e-12:
            pairs = [*pairs, (there - x, steep - slope)][-memory:]
        done = value - now < 1e-7 * max(abs(value), 1)
        x, value, slope = there, now, steep
        if done:
            break
    return x


def fit(docs: DataFrame, labels: DataFrame, sample: int = 5_000) -> Model:
    """Learn from ``labels`` (doc_id, toxic 0 or 1; others are no labels) and the texts
    of ``docs``. At most about ``sample`` documents of a class enter the regression;
    log-count ratios come from all."""
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .distinct()
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    found = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    clean, toxic = found.get(0, 0), found.get(1, 0)
    prior = float(np.log((toxic + 0.5) / (clean + 1)))
    if not (clean and toxic):
        return Model(np.zeros(1 << BITS, dtype=np.float32).tobytes(), prior)
    small = F.broadcast if clean + toxic <= LABELS_AT_ONCE else (lambda table: table)
    counts = (
        texts.join(small(marks), "doc_id")
        .select("toxic", "text")
        .mapInArrow(_count, "bucket long, clean long, toxic long")
        .groupBy("bucket")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    )
    ratios = log_count_ratios(counts)
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 32))
    share = F.when(F.col("toxic") == 1, min(1.0, sample / toxic)).otherwise(min(1.0, sample / clean))
    drawn = marks.filter(draw < share * (1 << 32))
    row = (
        texts.join(F.broadcast(drawn), "doc_id")
        .select("toxic", "text")
        .coalesce(1)
        .mapInArrow(_fit(ratios.tobytes()), "weights binary, intercept double")
        .first()
    )
    return Model(bytes(row["weights"]), row["intercept"] + prior)


def _scoring(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            scores = model.value.scores(grams, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: ``doc_id, score, predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(_scoring(shared), "doc_id long, score double")
        .withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    )


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """The fold that is never learnt from; a null id is in it."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def op13_naive_bayes_grams(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
