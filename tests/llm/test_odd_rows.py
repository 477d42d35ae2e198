"""Every operator over odd rows and over an empty table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fieldtally.llm import (
    dartminhash,
    decontamination,
    language,
    passages,
    personal,
    quality,
    segmentation,
    sharding,
    token_counts,
    token_files,
)
from fieldtally.sources.staging import run_folder


def shards(docs):
    return sharding.bounded_ring(
        sharding.measured(docs), F.xxhash64("doc_id"), shards=4, ties=["doc_id", "text_crc32"]
    )


def files(docs):
    folder = run_folder(docs.sparkSession, "tokens")
    token_files.write_token_files(docs, folder, 3)
    return token_files.read_documents(docs.sparkSession, folder, 50257)


def contained(docs):
    items = docs.sparkSession.createDataFrame(
        [(1, "same words here again and more"), (2, None), (3, ""), (4, "too short")],
        "item_id long, text string",
    )
    return decontamination.contained_items(docs, items)


ONE_EACH = {
    "quality": lambda d: quality.quality(d, least=2, steps=1),
    "near_duplicates": dartminhash.near_duplicates,
    "shards": shards,
    "language": language.identify,
    "files": files,
    "counts": token_counts.count_tokens,
    "personal": lambda d: personal.with_spans(d, personal.fit(d)),
    "redacted": personal.redacted,
}
OTHERS = {
    "segmentations": segmentation.sample_segmentations,
    "contained": contained,
    "passages": passages.repeated_passages,
}


@pytest.mark.parametrize("name", ONE_EACH)
def test_one_row_for_each_odd_row(odd, name):
    found = ONE_EACH[name](odd).select("doc_id").collect()
    assert sorted(str(r[0]) for r in found) == sorted(str(r[0]) for r in odd.select("doc_id").collect())


@pytest.mark.parametrize("name", [*ONE_EACH, *OTHERS])
def test_empty_table(empty, name):
    assert {**ONE_EACH, **OTHERS}[name](empty).count() == 0


def test_odd_near_duplicates(odd):
    classes = {}
    for row in dartminhash.near_duplicates(odd).collect():
        classes.setdefault(row["doc_id"], set()).add(row["class_id"])
    assert classes[1] == classes[2] == {1}  # a null text is empty
    assert classes[3] == {3} and classes[4] == {4} and classes[8] == {7} and classes[9] == {9}
    assert classes[None] == {1, None}


def test_odd_segmentations(odd):
    rows = segmentation.decode_segmentations(segmentation.sample_segmentations(odd)).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] is not None}
    assert all(r["text"] == texts[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert [len(r["ids"]) for r in rows if r["doc_id"] == 2] == [0]


def test_odd_passages(odd):
    found = passages.repeated_passages(odd).collect()
    assert {(r["doc_id"], r["other_id"]) for r in found} == {(7, 8), (8, 7)}


def test_odd_contained_items(odd):
    found = contained(odd).collect()
    assert [(r["doc_id"], r["item_id"], r["overlap"], r["start"]) for r in found] == [(9, 1, 1.0, 0)]


def test_odd_redaction(odd):
    clean = {r["doc_id"]: r["text"] for r in personal.redacted(odd).collect()}
    assert clean[10] == "mail [EMAIL] call [PHONE] 日本語 😀" and clean[1] is None and clean[2] == ""


def test_odd_languages(odd):
    found = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["rejected"] for i in (1, 2, 3, 4))
