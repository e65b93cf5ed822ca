"""Every stage of the pipeline on the small tables, against what its operator decides."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixquery.llm import decontamination, quality, queries, scratch

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_stages(spark):
    docs = queries.table(spark, DIR, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = scratch.written(stage(spark, docs, DIR), f"test-{name}")
        kept[name] = docs.count()
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "quality_rules":
            good = quality.quality_rules(before).where("kept").select("doc_id")
            assert good.exceptAll(docs.select("doc_id")).count() == 0 and good.count() == kept[name]
        if name == "line_dedup":
            lines = docs.select(F.explode(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.lower(F.trim(x))))).alias("x")).where("x <> ''")
            assert lines.groupBy("x").count().where("count >= 10").count() == 0
        if name == "benchmark_decontamination":
            bench = queries.table(spark, DIR, "benchmark")
            bad = decontamination.leaks(before, bench, ["doc_id"]).select("doc_id").distinct()
            assert kept[name] == before.count() - bad.count()
        if name == "best_fit_packing":
            assert docs.select("doc_id").distinct().count() == before.count()
    assert kept["quality_rules"] > kept["ngram_jaccard_join"] > 0
