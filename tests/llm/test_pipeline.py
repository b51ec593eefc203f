from __future__ import annotations

import corpus_pipeline
from visiquarry.llm import decontam, langid, pii


def test_stages_take_effect(spark, sf_dir, docs):
    frame, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, sf_dir).cache()
        assert frame.columns == docs.columns
        assert frame.count() <= before
        before = frame.count()
        if name == "language":
            assert before == docs.where("text rlike '[A-Za-z]'").count()
        if name == "decontamination":
            assert decontam.find(frame, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
        if name == "personal_data":
            assert all(not pii.find_base(r.text) for r in frame.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).select("doc_id").distinct().count() == before


def test_run_and_odd_tables(spark, sf_dir, odd, empty):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for frame in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, sf_dir)
        assert frame.columns == (odd.columns if "key" in frame.columns else empty.columns)
        corpus_pipeline.STAGES[-1][1](spark, frame, sf_dir).count()


def test_texts_without_letters_are_rejected(spark, sf_dir, odd):
    kept = corpus_pipeline.language(spark, odd, sf_dir)
    assert {r.doc_id for r in kept.collect()}.isdisjoint({1, 2, 6})
    assert langid.UND == "und"


def test_language_stage_keeps_columns_as_they_came(spark, docs):
    """Names that the operator uses itself, and a column of structs."""
    given = docs.limit(300).selectExpr("*", "42.0 AS score", "'mine' AS lang_pred", "named_struct('x', doc_id) AS d", "7 AS h")
    kept = corpus_pipeline.language(spark, given, "")
    assert kept.columns == given.columns and kept.count() > 100
    assert kept.where("score <> 42 or lang_pred <> 'mine' or d.x <> doc_id or h <> 7").count() == 0
    assert kept.join(given.select("doc_id", given.text.alias("t")), "doc_id").where("t <> text").count() == 0
