"""The stages in order, each on what the one before kept."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"



@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_on_the_smallest_tables(spark, tmp_path):
    import corpus_pipeline
    from quire.llm import secrets

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SF).write.parquet(str(tmp_path / str(i)))
        after = spark.read.parquet(str(tmp_path / str(i)))
        if name != "best_fit_packing":
            assert after.columns == columns
        if name in ("quality_rules", "near_dedup"):
            assert 0 < after.count() < before.count()
            assert after.select("doc_id").distinct().count() == after.count()
        if name == "secret_scan":
            assert after.count() == before.count()
            assert not any(secrets.find_secrets(r["text"]) for r in after.select("text").collect())
            assert after.where("n_chars <> length(text)").isEmpty()
        if name == "source_mixing":
            words = F.size(F.array_remove(F.split("text", r"\s+"), ""))
            total = lambda df: df.agg(F.sum(words)).first()[0]
            assert total(after) == pytest.approx(1.5 * total(before), rel=0.02)
            assert max(Counter(r[0] for r in after.select("doc_id").collect()).values()) <= 2
        if name == "best_fit_packing":
            ids = {r[0] for r in after.select("doc_id").distinct().collect()}
            assert ids == {r[0] for r in before.select("doc_id").distinct().collect()}
            assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024
        before = after


def test_names_of_stages():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]


def test_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, doc string, copies long, fp long, hash long, size long"
    text = lambda i: " ".join(f"word{i}x{j}" for j in range(60 + i)) + "."
    rows = [(i, text(i), "en", ["a", "b", None][i % 3], 10, "clash", 1, 2, 3, 4) for i in range(40)]
    rows += [rows[0], rows[0], (None, text(100), None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (50, "", "en", "a", 0, None, None, None, None, None)]
    for name, table in (("odd", spark.createDataFrame(rows, schema)), ("empty", spark.createDataFrame([], schema))):
        before = table.repartition(3)
        for i, (stage, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, before, SF).write.parquet(str(tmp_path / f"{name}{i}"))
            after = spark.read.parquet(str(tmp_path / f"{name}{i}"))
            if stage != "best_fit_packing":
                assert after.columns == before.columns
            if name == "odd" and stage == "quality_rules":
                assert after.count() == len(rows) - 2  # the two without words go
            if name == "odd" and stage == "near_dedup":
                assert sorted((r[0] is None, r[0] or 0) for r in after.select("doc_id").collect()) == [(False, i) for i in range(40)] + [(True, 0)]
            if name == "empty":
                assert after.count() == 0
            before = after


def test_stage_of_wide_ids(spark):
    import corpus_pipeline

    wide = (1 << 60) + 1
    docs = spark.createDataFrame([(wide, "one two three four five six"), (None, "seven eight nine ten eleven")], "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "length(text) AS n_chars")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
    assert {r["doc_id"] for r in docs.collect()} <= {wide, None} and docs.count() > 0
