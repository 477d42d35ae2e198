"""Token files compressed by Re-Pair.

Documents are range-partitioned by doc_id and sorted; each partition is encoded
with the tokenizer and cut into blocks. Inside a block, frequent pairs of
neighbouring ids are repeatedly replaced by new symbols. A block is one row of a
Parquet table: the rules, how many ids each rule expands to, the remaining
symbols, and the documents' lengths. From the expansion lengths any range of ids
can be decoded without expanding the block (``ids_between``).

Rounds replace many pairs at once instead of one: all pairs that occur often enough
and in whose occurrences no more frequent pair overlaps, so that a round is a few
passes over arrays. Files are written by Spark's committer, so lost executors leave
no partial files; only block sizes come together, never ids.

Defined results: a null text is empty and has the end id only; repeated rows are
written each, in the order of doc_id, then of text; null doc_ids come first; extra
columns are ignored; an empty table gives an empty table of files.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from fieldtally.llm.batches import code_points, first_of_each, firsts, in_chunks, ranges, segment_hashes
from fieldtally.sources.staging import run_folder, stage

END_ID = 2
#: Characters worked on at once in a worker; also bounds a block.
CHUNK = 2_000_000
#: Distinct words whose ids a worker remembers.
REMEMBERED = 800_000
#: Blocks whose starts are broadcast (24 bytes each).
BLOCKS_AT_ONCE = 500_000
#: How often a pair must occur to be frequent. A rule takes 12 bytes and time of its own.
LEAST_COUNT = 16
BLOCK = (
    "file int, block int, first_doc long, doc_ids binary, doc_lengths binary, rules binary, "
    "rule_lengths binary, symbols binary"
)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Classes of characters for the tokenizer's pattern (fixed: 's|'t|'re|'ve|'m|'ll|'d|
# ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+).
_LETTER, _NUMBER, _OTHER, _BLANK = range(4)
_SUFFIXES = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_WHITE = "\t\n\x0b\f\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    categories = "".join(map(unicodedata.category, map(chr, range(0x110000))))
    groups = np.frombuffer(categories.encode(), dtype="S1")[::2]
    kinds = np.full(0x110000, _OTHER, dtype=np.int8)
    kinds[groups == b"L"], kinds[groups == b"N"] = _LETTER, _NUMBER
    kinds[[ord(c) for c in _WHITE]] = _BLANK
    return kinds


def word_starts(points: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Positions at which the pattern starts a new word, for texts that begin at
    ``begins`` in one array of code points."""
    kinds = _classes()[points]
    first = np.zeros(len(points), dtype=bool)
    first[begins] = True
    cut = first.copy()
    cut[1:] |= kinds[1:] != kinds[:-1]
    # White space before a word: the last blank stands alone or, if it is a plain
    # space, joins the word.
    blank = kinds == _BLANK
    last_of_text = np.ones(len(points), dtype=bool)
    last_of_text[:-1] = first[1:]
    before_word = np.zeros(len(points), dtype=bool)
    before_word[:-1] = blank[:-1] & ~blank[1:] & ~last_of_text[:-1]
    cut |= before_word
    joins = np.zeros(len(points), dtype=bool)
    joins[1:] = before_word[:-1] & (points[:-1] == 32)
    cut &= ~joins | first
    return _with_suffixes(points, kinds, cut, first, joins)


def _with_suffixes(points, kinds, cut, first, joins) -> np.ndarray:
    """Contractions are words of their own where a word would start with the
    apostrophe; what follows starts anew."""
    apostrophes = np.flatnonzero((points == 39) & cut)
    if not len(apostrophes):
        return np.flatnonzero(cut)
    size = len(points)
    for at in apostrophes.tolist():
        # The word here is the apostrophe and other signs after it.
        for suffix in _SUFFIXES:
            end = at + len(suffix)
            if end <= size and all(points[at + i] == ord(c) for i, c in enumerate(suffix)):
                if first[at + 1 : end].any():
                    continue
                cut[at + 1 : end] = False
                if end < size:
                    cut[end] = True
                break
    return np.flatnonzero(cut)


class Encoder:
    """Ids of texts; words are encoded once and remembered by their hashes. Texts in
    which a token added to the vocabulary is spelled out are cut there by the library."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        added = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.number = np.zeros(0, dtype=np.int64)  # words in the order of the sorted hashes
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an end id after each text, and the number of ids of each text."""
        odd = [i for i, t in enumerate(texts) if self.added and self.added.search(t)]
        if not odd:
            return self._by_words(texts)
        others = list(texts)
        for i in odd:
            others[i] = ""
        flat, sizes = self._by_words(others)
        parts = np.split(flat, np.cumsum(sizes)[:-1])
        for i in odd:
            ids = self.whole.encode(texts[i], add_special_tokens=False).ids
            parts[i] = np.array([*ids, END_ID], dtype=np.uint32)
        return np.concatenate(parts), np.array([len(p) for p in parts], dtype=np.int64)

    def _by_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, lengths = code_points(texts)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        starts = (
            word_starts(points, begins[lengths > 0]) if len(points) else np.zeros(0, dtype=np.int64)
        )
        sizes = np.diff(np.append(starts, len(points)))
        places, distinct = pd.factorize(segment_hashes(points, starts, sizes))
        joined = "".join(texts)
        first = firsts(places, len(distinct))
        found = self._find(distinct, joined, starts[first], sizes[first])
        word = found[places] if len(places) else places
        counts = self.sizes[word]
        words_before = np.searchsorted(starts, ends)
        # Each text's words, then its end id.
        running = np.append(0, np.cumsum(counts))
        per_text = np.diff(np.append(0, running[words_before])) + 1
        total = int(per_text.sum())
        result = np.empty(total, dtype=np.uint32)
        last = np.cumsum(per_text) - 1
        result[last] = END_ID
        inside = np.ones(total, dtype=bool)
        inside[last] = False
        result[inside] = self.ids[ranges(self.starts[word], counts)]
        return result, per_text

    def _find(self, hashes, joined, starts, sizes) -> np.ndarray:
        if len(self.hashes) > REMEMBERED:
            self.forget()
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            word = self.number[at]
            fresh = np.flatnonzero(self.hashes[at] != hashes)
        else:
            fresh = np.arange(len(hashes))
            word = np.empty(len(hashes), dtype=np.int64)
        if len(fresh):
            word[fresh] = np.arange(len(fresh)) + len(self.sizes)
            words = [joined[s : s + n] for s, n in zip(starts[fresh].tolist(), sizes[fresh].tolist())]
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            counts = np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded))
            flat = np.fromiter(chain.from_iterable(encoded), dtype=np.uint32, count=int(counts.sum()))
            order = np.argsort(hashes[fresh])
            into = np.searchsorted(self.hashes, hashes[fresh][order])
            self.hashes = np.insert(self.hashes, into, hashes[fresh][order])
            self.number = np.insert(self.number, into, order + len(self.sizes))
            self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
            self.sizes = np.append(self.sizes, counts)
            self.ids = np.append(self.ids, flat)
        return word


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker process, which has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


@dataclass(frozen=True)
class Grammar:
    """``symbols`` below ``first`` are ids, others stand for the pair in that row of
    ``rules``; ``lengths`` are the rules' numbers of ids."""

    first: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    def expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules' ids one after another, and where each begins. Rules only use
        earlier rounds, so a few passes resolve them all."""
        begins = np.cumsum(self.lengths) - self.lengths
        flat = np.zeros(int(self.lengths.sum()), dtype=np.uint32)
        # Ranges of symbols still to be written: where to, and which symbol.
        where = np.stack([begins, begins + self._size(self.rules[:, 0])], axis=1).reshape(-1)
        what = self.rules.reshape(-1).astype(np.int64)
        while len(what):
            plain = what < self.first
            flat[where[plain]] = what[plain]
            rule = what[~plain] - self.first
            left = where[~plain]
            right = left + self._size(self.rules[rule, 0])
            where = np.stack([left, right], axis=1).reshape(-1)
            what = self.rules[rule].reshape(-1).astype(np.int64)
        return flat, begins

    def _size(self, symbols: np.ndarray) -> np.ndarray:
        symbols = symbols.astype(np.int64)
        if not len(self.lengths):
            return np.ones(len(symbols), dtype=np.int64)
        rule = np.maximum(symbols - self.first, 0)
        return np.where(symbols < self.first, 1, self.lengths[np.minimum(rule, len(self.lengths) - 1)])

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begins = self.expansions()
        table = np.append(np.arange(self.first, dtype=np.uint32), flat)
        at = symbols.astype(np.int64)
        if len(begins):
            rule = np.clip(at - self.first, 0, len(begins) - 1)
            at = np.where(at < self.first, at, self.first + begins[rule])
        return table[ranges(at, self._size(symbols))]

    def ids_between(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the block; only symbols that touch the range
        are expanded."""
        reached = np.cumsum(self._size(self.symbols))
        low = int(np.searchsorted(reached, start, side="right"))
        high = int(np.searchsorted(reached, end, side="left")) + 1
        before = int(reached[low - 1]) if low else 0
        return self.expand(self.symbols[low:high])[start - before : end - before]


def repair(ids: np.ndarray, first: int, least: int = LEAST_COUNT) -> Grammar:
    """Replace pairs by new symbols until none occurs ``least`` times.

    A pair that is rare now stays rare unless a new symbol is in it, so after the first
    round only places beside new symbols and those of frequent pairs are counted. The
    most frequent pair is always replaced, so every round comes closer to the end."""
    symbols = ids.astype(np.int64)
    rules, lengths = [], [np.ones(first, dtype=np.int64)]
    known, sizes = first, lengths[0]
    # Symbols keep their places; a replaced pair's second place is skipped from then on.
    end = len(symbols)
    after, before = np.arange(1, end + 1), np.arange(-1, end - 1)
    there = np.ones(end, dtype=bool)
    live = np.arange(max(end - 1, 0))
    while len(live):
        places, distinct = pd.factorize(symbols[live] << np.int64(32) | symbols[after[live]])
        counts = np.bincount(places, minlength=len(distinct))
        often = counts[places] >= least
        if not often.any():
            break
        # An occurrence is taken if its pair is frequent and more frequent than its
        # neighbours on both sides (ties: the pair that comes first in the block).
        ranks = counts * len(distinct) + np.arange(len(distinct))[::-1]
        places, at = places[often], live[often]
        weight = ranks[places]
        joined = at[1:] == after[at[:-1]]
        left = np.append(0, np.where(joined, weight[:-1], 0))
        right = np.append(np.where(joined, weight[1:], 0), 0)
        # Only pairs of one symbol stand beside themselves: every second is taken.
        order = np.arange(len(at))
        start = np.maximum.accumulate(np.where(weight != left, order, 0))
        taken = (weight >= left) & (weight >= right) & ((order - start) % 2 == 0)
        used = np.bincount(places[taken], minlength=len(distinct))
        chosen = np.flatnonzero(used >= max(2, least // 2))
        number = np.full(len(distinct), -1, dtype=np.int64)
        number[chosen] = np.arange(len(chosen)) + known
        taken &= number[places] >= 0
        pair = np.stack([distinct[chosen] >> np.int64(32), distinct[chosen] & np.int64(0xFFFFFFFF)], axis=1)
        rules.append(pair)
        lengths.append(sizes[pair].sum(axis=1))
        sizes = np.concatenate(lengths)
        known += len(chosen)
        made = at[taken]
        symbols[made] = number[places[taken]]
        gone = after[made]
        there[gone] = False
        after[made] = after[gone]
        inner = after[made] < end
        before[after[made[inner]]] = made[inner]
        asked = np.concatenate([at[~taken], made, before[made]])
        asked = np.sort(asked[asked >= 0])
        asked = asked[first_of_each(asked)]
        live = asked[there[asked] & (after[asked] < end)]
    symbols = symbols[there]
    table = np.concatenate(rules) if rules else np.zeros((0, 2), dtype=np.int64)
    return Grammar(first, table.astype(np.uint32), sizes[first:], symbols.astype(np.uint32))


def _packed(values: np.ndarray, kind: str = "<u4") -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def _encoding(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        first, block = encoder.tokenizer.get_vocab_size(), 0
        for batch in batches:
            done = 0
            file = batch.column(0)[0].as_py() if batch.num_rows else 0
            for texts in in_chunks(batch.column(2).to_pylist(), CHUNK):
                names = batch.column(1).slice(done, len(texts))
                done += len(texts)
                ids, lengths = encoder.encode(texts)
                grammar = repair(ids, first)
                present = names.fill_null(np.iinfo(np.int64).min).to_numpy()
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "file": file, "block": block, "first_doc": int(present[0]),
                            "doc_ids": _packed(present, "<i8"), "doc_lengths": _packed(lengths, "<i8"),
                            "rules": _packed(grammar.rules), "rule_lengths": _packed(grammar.lengths),
                            "symbols": _packed(grammar.symbols),
                        }
                    ],
                    schema=_block_schema(),
                )
                block += 1

    return encode


def _block_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (field.split() for field in BLOCK.split(", "))])


def write_token_files(docs: DataFrame, folder: str, files: int, path: str | None = None) -> None:
    """Encode and write all texts to ``folder``, in ascending order of doc_id over
    ``files`` files and the blocks in each."""
    path = path or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = (
        rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
        .select(F.spark_partition_id().alias("file"), "doc_id", "text")
    )
    ordered.mapInArrow(_encoding(path), BLOCK).write.parquet(folder)


def read_block(row: dict, first: int) -> tuple[np.ndarray, np.ndarray, Grammar]:
    """Documents, their lengths, and the grammar of a block."""
    rules = np.frombuffer(row["rules"], dtype="<u4").reshape(-1, 2)
    lengths = np.frombuffer(row["rule_lengths"], dtype="<u4").astype(np.int64)
    grammar = Grammar(first, rules, lengths, np.frombuffer(row["symbols"], dtype="<u4"))
    return (
        np.frombuffer(row["doc_ids"], dtype="<i8"), np.frombuffer(row["doc_lengths"], dtype="<i8"), grammar
    )


def _reading(first: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, lengths, grammar = read_block(row, first)
                raw = grammar.expand(grammar.symbols).astype("<u4").tobytes()
                ends = 4 * np.cumsum(lengths)
                crcs = [zlib.crc32(raw[s:e]) for s, e in zip((ends - 4 * lengths).tolist(), ends.tolist())]
                nothing = names == np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, mask=nothing), pa.array(row["before"] + ends // 4 - lengths),
                        pa.array(lengths), pa.array(crcs, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return read


def read_documents(spark, folder: str, first: int) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    blocks = spark.read.schema(BLOCK).parquet(folder)
    counts = stage(
        blocks.select("file", "block", "doc_lengths").mapInArrow(_block_sizes, "file int, block int, n_ids long"),
        "blocks",
    )
    # One narrow row for each block of some million characters; files are summed
    # first, so each window is bounded by the number of files, or of blocks in one.
    per_file = counts.groupBy("file").agg(F.sum("n_ids").alias("in_file"))
    upto = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = per_file.withColumn("before_file", F.coalesce(F.sum("in_file").over(upto), F.lit(0)))
    inside = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.withColumn("in_front", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
        .join(files, "file")
        .select("file", "block", (F.col("before_file") + F.col("in_front")).alias("before"))
    )
    few = counts.count() <= BLOCKS_AT_ONCE
    placed = blocks.join(F.broadcast(starts) if few else starts, ["file", "block"])
    return placed.mapInArrow(_reading(first), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _block_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = batch.to_pylist()
        yield pa.RecordBatch.from_pydict(
            {
                "file": pa.array([r["file"] for r in table], pa.int32()),
                "block": pa.array([r["block"] for r in table], pa.int32()),
                "n_ids": pa.array([int(np.frombuffer(r["doc_lengths"], dtype="<i8").sum()) for r in table], pa.int64()),
            }
        )


def op7_repair_tokens(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = run_folder(spark, "tokens")
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    path = default_path()
    write_token_files(docs, folder, files, path)
    return read_documents(spark, folder, Tokenizer.from_file(path).get_vocab_size())
