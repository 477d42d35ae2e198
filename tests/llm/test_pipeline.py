from __future__ import annotations

import corpus_pipeline
from fieldtally.llm import decontamination, personal, segmentation
from fieldtally.sources import staging
from tests.llm.conftest import SMALLEST
from tests.llm.test_near_duplicates import brute_classes


def test_stages_take_effect(spark, documents, texts):
    columns = documents.columns
    docs, kept = documents, {}
    for name, apply in corpus_pipeline.STAGES:
        after = apply(spark, docs, SMALLEST)
        path = corpus_pipeline.run_folder(spark, name)
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            kept[name] = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert len(kept["language"]) >= len(texts) - 3
    classes = brute_classes(kept["language"])
    assert set(kept["near_duplicates"]) == set(classes.values())
    bench = spark.read.parquet(f"{SMALLEST}/benchmark.parquet")
    leaks = {r["doc_id"] for r in decontamination.contained_items(documents, bench).collect()}
    assert set(kept["decontamination"]) == set(kept["near_duplicates"]) - leaks
    assert set(kept["personal_data"]) == set(kept["decontamination"])
    again = spark.createDataFrame(list(kept["personal_data"].items()), "doc_id long, text string")
    assert personal.with_spans(again, personal.SpanModel()).filter("size(pii_base) > 0").count() == 0
    last = docs.collect()
    assert {r["doc_id"] for r in last} == set(kept["personal_data"])


def test_repeated_rows_leave_one(spark, documents):
    twice = documents.unionByName(documents)
    once = corpus_pipeline.without_near_duplicates(spark, documents, SMALLEST)
    found = corpus_pipeline.without_near_duplicates(spark, twice, SMALLEST)
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(r["doc_id"] for r in once.collect())


def test_rows_of_one_doc_id_with_other_words_stay(spark):
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    docs = spark.createDataFrame(
        [(1, words[0]), (1, words[1]), (1, words[1]), (5, words[0]), (5, words[2]), (None, words[2]), (None, None)],
        "doc_id long, text string",
    )
    found = corpus_pipeline.without_near_duplicates(spark, docs, SMALLEST).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=repr) == sorted(
        [(1, words[0]), (1, words[1]), (5, words[2]), (None, words[2]), (None, None)], key=repr
    )


def test_every_stage_over_odd_and_empty_rows(spark, odd, empty):
    for docs in (odd, empty):
        for name, apply in corpus_pipeline.STAGES:
            after = apply(spark, docs, SMALLEST)
            rows = after.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert after.columns == docs.columns and rows <= docs.count()
            if docs is empty:
                assert rows == 0


def test_few_texts_at_once_and_no_two_kinds_of_workers(spark, monkeypatch):
    """The executors' memory is bounded: texts go to workers in small batches, and samples
    are written before they are decoded."""
    docs = spark.range(4_000, numPartitions=1).selectExpr(
        "id as doc_id", "concat('word', id, ' and more') as text", "'en' as lang", "'a' as source", "15L as n_chars"
    )
    # One partition of one file, so that a batch is as large as it may be.
    path = corpus_pipeline.run_folder(spark, "batches")
    docs.write.parquet(path)
    written, folder = [], staging.run_folder

    def noted(spark, name):
        written.append((name, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
        return folder(spark, name)

    monkeypatch.setattr(staging, "run_folder", noted)
    docs = spark.read.parquet(path)
    corpus_pipeline.in_known_language(spark, docs, SMALLEST)
    # Nested stages of Spark alone keep their batches.
    assert all(rows <= 1_000 for name, rows in written if name == "languages")
    assert sum(name == "grams" and rows <= 1_000 for name, rows in written) >= 1
    written.clear()
    last = corpus_pipeline.segmented(spark, docs, SMALLEST)
    assert [name for name, rows in written if rows <= 1_000] == ["sampled", "decoded"]
    assert "MapInArrow" not in last._jdf.queryExecution().executedPlan().toString()
    found = last.filter("sample = 1").select("doc_id", "text_crc32").collect()
    told = docs.selectExpr("doc_id", "crc32(cast(text as binary)) as text_crc32").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, told))


def test_what_a_worker_holds_changes_no_sample(spark, documents):
    docs = documents.limit(60)
    usual, small = (
        segmentation.sample_segmentations(docs, **held).orderBy("doc_id", "sample").collect()
        for held in ({}, {"characters": 2_000, "remembered": 50})
    )
    for a, b in zip(usual, small, strict=True):
        assert (a["doc_id"], a["sample"], a["ids"]) == (b["doc_id"], b["sample"], b["ids"])
        assert abs(a["noisy"] - b["noisy"]) < 1e-9 and abs(a["log_chance"] - b["log_chance"]) < 1e-6
