"""Token counts, sampled segmentations and token files against the libraries."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter as Tally

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from fieldtally.llm import segmentation as s
from fieldtally.llm import batches, token_counts, token_files, unigram
from tests.llm.conftest import SMALLEST

ODD = [
    "", " ", "  a  b ", "日本語 test\n\n x", "😀 ok 😀😀", "▁▁x", "a" * 500, "123 4567", "\t tab",
    "a's 's it's don't we'll'd \n\n 'S ''s !'s 12's x''re  's", "a \n", "<|endoftext|> x", "²x é́",
]


@pytest.fixture(scope="module")
def vocabulary():
    return unigram.load(unigram.default_path())


@pytest.fixture(scope="module")
def library(vocabulary):
    """The library with the same pieces, scores and the unigram algorithm."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(unigram.default_path(), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    for i, piece in enumerate(model.pieces):
        if np.isfinite(vocabulary.scores[i]):
            piece.score, piece.type = float(vocabulary.scores[i]), 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_counts_are_those_of_the_library(library, texts):
    every = [*ODD, *list(texts.values())[:60]]
    found = token_counts.Counter(unigram.default_path()).of_texts(every)
    assert [int(n) for n in found[:, 0]] == [len(library.encode(t)) for t in every]


def test_count_query(spark, library, texts):
    found = token_counts.op8_count_viterbi(spark, SMALLEST).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {i: len(library.encode(t)) for i, t in texts.items()}


def segmentations(text, vocabulary):
    marked = unigram.normalised(text)
    scores = {p: x for p, x in zip(vocabulary.pieces, vocabulary.scores) if np.isfinite(x)}
    paths = []

    def extend(at, pieces, score):
        if at == len(marked):
            paths.append((tuple(pieces), score))
        for end in range(at + 1, min(len(marked), at + 16) + 1):
            if marked[at:end] in scores:
                extend(end, [*pieces, marked[at:end]], score + scores[marked[at:end]])

    extend(0, [], 0.0)
    return paths


def sampled(texts, keys, k, alpha, vocabulary):
    store = s.Lattices(vocabulary, alpha)
    *found, last = list(s.sample_batch(texts, keys, store, k))
    pieces = []
    for _, _, _, edges, counts in found:
        ids, sizes = s._ids(store, edges, counts)
        ends = np.cumsum(sizes)
        pieces.append([tuple(vocabulary.pieces[i] for i in ids[e - n : e]) for e, n in zip(ends, sizes)])
    return found, last, pieces


def test_samples_follow_the_distribution_without_replacement(vocabulary):
    paths = segmentations("hello on", vocabulary)
    weights = np.array([math.exp(0.3 * score) for _, score in paths])
    chances = dict(zip([p for p, _ in paths], weights / weights.sum()))
    n = 20_000
    found, last, pieces = sampled(["hello on"] * n, np.arange(n), 3, 0.3, vocabulary)
    second = {
        b: sum(p * chances[b] / (1 - p) for a, p in chances.items() if a != b) for b in chances
    }
    for expected, got in ((chances, Tally(pieces[0])), (second, Tally(pieces[1]))):
        for path, p in expected.items():
            assert abs(got[path] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 2
    assert all(len({a, b, c}) == 3 for a, b, c in zip(*pieces))
    assert (found[0][1] >= found[1][1]).all() and (found[2][1] >= last[1]).all()
    inclusion = [-np.expm1(-np.exp(x[2] - last[1])) for x in found]
    assert abs(np.mean(sum(np.exp(x[2]) / i for x, i in zip(found, inclusion))) - 1) < 0.02


def test_all_segmentations_if_fewer_than_asked_for(vocabulary):
    found, last, pieces = sampled(["on"], np.array([3]), 50, 1.0, vocabulary)
    paths = {p for p, _ in segmentations("on", vocabulary)}
    assert {p for rank in pieces for p in rank} == paths
    assert np.isneginf(last[1]).all()


def test_segmentations_decode_and_do_not_depend_on_partitions(spark, documents):
    docs = documents.select("doc_id", "text").unionByName(
        spark.createDataFrame([(-i, t) for i, t in enumerate(ODD, 1)], "doc_id long, text string")
    )
    one = s.decode_segmentations(s.sample_segmentations(docs.coalesce(1)))
    many = s.sample_segmentations(docs.repartition(7)).select("doc_id", "sample", F.col("ids").alias("again"))
    both = one.join(many, ["doc_id", "sample"]).join(docs.withColumnRenamed("text", "given"), "doc_id")
    assert one.count() == both.count() >= 2 * docs.count() - 2
    # A space mark that stands in the text itself is decoded as a space.
    assert both.filter("ids <> again or text <> replace(given, '▁', ' ')").count() == 0


def test_encoder_gives_the_ids_of_the_library(texts):
    rng = random.Random(3)
    noise = ["".join(rng.choice(" '\nsdtrevlma1!?é  ") for _ in range(60)) for _ in range(200)]
    every = [*ODD, *noise, *list(texts.values())[:40]]
    tokenizer = Tokenizer.from_file(token_files.default_path())
    ids, lengths = token_files.Encoder(token_files.default_path()).encode(every)
    ends = np.cumsum(lengths)
    for text, end, n in zip(every, ends, lengths):
        assert ids[end - n : end].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    for ids in (
        rng.integers(0, 6, 5000), np.tile([1, 2, 3], 2000), np.zeros(999, dtype=int), np.array([5]),
        np.zeros(0, dtype=int),
    ):
        grammar = token_files.repair(ids.astype(np.uint32), 10)
        assert (grammar.expand(grammar.symbols) == ids).all()
        for _ in range(30):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2))
            if a < b:
                assert (grammar.ids_between(a, b) == ids[a:b]).all()
    assert len(token_files.repair(np.tile([1, 2, 3], 2000).astype(np.uint32), 10).symbols) < 600


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(7)
    for ids in (
        rng.integers(0, 5, 30_000), np.tile(np.arange(40), 200), np.zeros(5000, dtype=int),
        np.repeat(rng.integers(0, 3, 900), rng.integers(1, 9, 900)),
    ):
        grammar = token_files.repair(ids.astype(np.uint32), 50, least=16)
        left = grammar.symbols.astype(np.int64)
        seen, taken = Tally(), {}
        for at, pair in enumerate(zip(left[:-1].tolist(), left[1:].tolist())):
            # Overlapping occurrences of a symbol beside itself count once.
            if pair[0] != pair[1] or taken.get(pair) != at - 1:
                seen[pair] += 1
                taken[pair] = at
        assert max(seen.values(), default=0) < 16
        assert (grammar.expand(grammar.symbols) == ids).all()
        assert grammar.lengths.tolist() == [len(grammar.expand(np.array([50 + i]))) for i in range(len(grammar.rules))]


def test_file_query(spark, texts):
    tokenizer = Tokenizer.from_file(token_files.default_path())
    found = sorted(token_files.op7_repair_tokens(spark, SMALLEST).collect())
    start = 0
    for row, (doc_id, text) in zip(found, sorted(texts.items()), strict=True):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [2], dtype="<u4")
        assert tuple(row) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_the_gap_character_in_a_text_falls_to_bytes(spark):
    texts = ["a\U0010FFFFb", "\U0010FFFF", "\U0010FFFF\U0010FFFF x \U0010FFFE"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {r["doc_id"]: r for r in token_counts.count_tokens(docs).collect()}
    assert all(np.isfinite(r["score"]) for r in counts.values())
    assert [counts[i]["n_byte_tokens"] for i in range(3)] == [4, 4, 12]
    for row in s.decode_segmentations(s.sample_segmentations(docs)).collect():
        assert row["text"] == texts[row["doc_id"]]


def test_segments_of_one_text_have_one_hash_wherever_they_stand():
    for size in (5, 40, 1000):
        points = np.tile(np.array([97, 0x10FFFF, 0x20AC, 0, 32], dtype=np.uint32), size)
        starts = np.arange(0, 5 * size, 5)
        assert len(set(batches.segment_hashes(points, starts, np.full(size, 5)).tolist())) == 1
        assert len(set(batches.segment_hashes(points, starts, np.arange(size) % 5).tolist())) == 5
    # Powers are made once for all texts of about one length.
    assert batches._powers(batches._BASE, 7) is batches._powers(batches._BASE, 7)


def test_words_seen_before_and_new_ones_keep_their_order():
    encoder = token_files.Encoder(token_files.default_path())
    whole = token_files.Encoder(token_files.default_path()).whole
    for text in ("one two three", "four two one five three", "five six one"):
        ids, _ = encoder.encode([text])
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids + [token_files.END_ID]
