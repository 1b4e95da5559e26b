"""What the physical plans must look like, whatever the size of the data."""

import os

import pytest
from pyspark.sql import functions as F

from corpusfold.operators import filters, keywords, text
from corpusfold.session import write_shared
from corpusfold.suite.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
@pytest.mark.parametrize("name", ["noise_filter", "exclude_glob", "ext_class", "weighted_text", "unit_rollup",
                                  "skip_organized", "tags_text", "duration_cap", "transcript", "audio_content",
                                  "embedding_join", "folder_merge", "organize_plan", "undo_plan", "apply_plan",
                                  "keyword_scores", "term_stats"])
def test_no_cross_join_and_no_python_in_column_work(spark, name):
    found = plan(QUERIES[name](spark, SMALL))
    for step in ("CartesianProduct", "NestedLoop", "Python", "MapInArrow"):
        assert step not in found


@needs_tables
def test_only_utf16_leaves_the_jvm_when_bytes_are_decoded(spark):
    found = plan(QUERIES["decode_bytes"](spark, SMALL))
    assert found.count("ArrowEvalPython") == 1 and "BatchEvalPython" not in found and "Exchange" not in found


@needs_tables
def test_scans_read_only_what_is_used(spark):
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(QUERIES["corpus_scan"](spark, SMALL))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan(QUERIES["noise_filter"](spark, SMALL))
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("lang = 'en'").withColumn("path", F.col("doc_id").cast("string"))
    found = plan(text.weighted_text(docs, content="text").select("text"))
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in found and "source" not in found
    assert "Exchange" not in found


def test_filters_on_paths_do_not_shuffle(spark):
    df = spark.range(10).select(F.col("id").cast("string").alias("rel_path"))
    kept = filters.classify_ext(filters.unit_key(filters.exclude_globs(filters.drop_noise(df), ["*.log"])))
    assert "Exchange" not in plan(kept)


def test_keywords_aggregate_and_rank_before_the_shuffle(spark):
    df = spark.createDataFrame([(0, "solar panels store energy and heat")], "cluster int, text string")
    counted = plan(keywords.gram_counts(df))
    assert counted.count("HashAggregate") == 2 and "partial_sum" in counted
    grams = write_shared(keywords.gram_counts(df), "grams")
    stats = plan(keywords.term_stats(grams))
    # One exchange for the words, one for their neighbours, none for joining the two.
    assert stats.count("Exchange hashpartitioning") == 2
    scores = spark.createDataFrame([(0, "a", 1.0)], "cluster int, keyword string, score double")
    assert plan(keywords.keyword_topk(scores)).count("WindowGroupLimit") == 2
