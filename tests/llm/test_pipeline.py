"""The pipeline's stages, one after the other."""

from collections import Counter

import corpus_pipeline
from laneguard.session import materialize

from .rows import hard_docs, no_docs


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > sizes[4] > 0  # the line stage takes copies whose lines all repeat
    raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0 < corpus_pipeline.near_copies(spark, raw, sf_dir).count() < sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert max(Counter(r["sequence_id"] for r in packed).values()) > 1


def test_emptied_documents_go_and_empty_ones_stay(spark, sf_dir):
    line = "a line that is long enough to be compared with others"
    rows = [(1, line), (2, line), (3, line + "!"), (4, None), (5, ""), (6, " \n "), (7, line + "\nand one of its own that stays"), (None, line)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, docs, sf_dir).collect()}
    assert got == {1: line, 4: None, 5: "", 6: " \n ", 7: "and one of its own that stays", None: line}


def test_hard_rows_and_no_rows_pass_all_stages(spark, sf_dir):
    for docs in (hard_docs(spark), no_docs(spark)):
        some = not docs.isEmpty()
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.columns, materialize(stage(spark, docs, sf_dir), "test-hard")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == before
        assert some or docs.isEmpty()
    docs = hard_docs(spark)
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = materialize(stage(spark, docs, sf_dir), "test-hard")
    texts = [r["text"] for r in docs.collect() if r["doc_id"] is not None and r["text"] and r["text"].strip()]
    assert texts
