"""Token counts without tokens: Viterbi over a unigram vocabulary that carries only
best score and number of pieces.

An Aho-Corasick automaton enumerates all pieces in the distinct words of a batch;
dynamic programming runs over all of these words side by side, position by
position. A text's count is the sum over its words. Words already counted in a
worker are remembered, about ``REMEMBERED`` of them.

Defined results: null and empty texts have no tokens; repeated rows are counted
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.batches import in_chunks
from fieldtally.llm.unigram import best_paths, default_path, lattice, load, words_of

#: Characters worked on at once in a worker.
CHUNK = 2_000_000
REMEMBERED = 1_000_000


class Counter:
    """Counts of words, remembered by their hashes."""

    def __init__(self, path: str) -> None:
        self.vocabulary = load(path)
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.values = np.zeros((0, 3))

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens, tokens that are bytes, and best score of each text."""
        words = words_of(texts, self.vocabulary)
        values = self._of_words(words.hashes, words.spellings)
        result = np.zeros((len(texts), 3))
        filled = np.flatnonzero(words.counts)
        if len(filled):
            starts = (np.cumsum(words.counts) - words.counts)[filled]
            result[filled] = np.add.reduceat(values[words.places], starts, axis=0)
        return result

    def _of_words(self, hashes: np.ndarray, spellings: list[str]) -> np.ndarray:
        if len(self.hashes) > REMEMBERED:
            self.hashes, self.values = self.hashes[:0], self.values[:0]
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), dtype=bool)
        values = np.zeros((len(hashes), 3))
        values[known] = self.values[at[known]]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            score, pieces, unknown = best_paths(lattice([spellings[i] for i in fresh], self.vocabulary))
            values[fresh] = np.stack([pieces, unknown, score], axis=1)
            every = np.append(self.hashes, hashes[fresh])
            order = np.argsort(every)
            self.hashes = every[order]
            self.values = np.concatenate([self.values, values[fresh]])[order]
        return values


@lru_cache(maxsize=1)
def _counter(path: str) -> Counter:
    """One for all tasks of a worker process."""
    return Counter(path)


def _counting(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            parts = [counter.of_texts(t) for t in in_chunks(batch.column(1).to_pylist(), CHUNK)]
            values = np.concatenate(parts) if parts else np.zeros((0, 3))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(values[:, 0].astype(np.int64)),
                    pa.array(values[:, 1].astype(np.int64)), pa.array(values[:, 2]),
                ],
                ["doc_id", "n_tokens", "n_byte_tokens", "score"],
            )

    return count


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, n_byte_tokens, score``. ``path`` is
    the piece file, present on all workers."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(
        _counting(path or default_path()),
        "doc_id long, n_tokens long, n_byte_tokens long, score double",
    )


def op8_count_viterbi(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
