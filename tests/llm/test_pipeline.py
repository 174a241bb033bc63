"""The corpus pipeline: every stage's decision takes effect, and its result equals the stages' operators on the same input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docgauge.llm import decontamination, jaccard_join, quality, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("steps")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_stages_keep_the_columns(spark, steps):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    assert all(s.columns == columns for s in steps[:-1])


def test_each_stage_acts_on_all_that_came_before(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    trusted = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    rows, node = corpus_pipeline.numbered(docs)
    scores = quality.perplexities(rows, rows.join(trusted, "doc_id").select(node), node)
    assert ids(steps[0]) == ids(rows.join(scores.where("kept").select(node), node)) and 0 < steps[0].count() < docs.count()
    assert ids(steps[1]) == ids(jaccard_join.jaccard_components(steps[0], words=5, num=80, den=100).where("doc_id = component_id"))
    leaked = {r.doc_id for r in decontamination.contaminated(steps[1], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert ids(steps[2]) == sorted(set(ids(steps[1])) - leaked) and leaked
    assert ids(steps[3]) == ids(steps[2])
    clean = {r.doc_id: r.text for r in steps[3].collect()}
    spans = {r.doc_id: r.spans for r in secret_scan.find_secrets(steps[2]).collect()}
    for r in steps[2].collect():
        assert (clean[r.doc_id] != r.text) == bool(spans[r.doc_id]) == ("[SECRET]" in clean[r.doc_id])
    assert not any(secret_scan.base_spans(t) for t in clean.values())
    pieces = steps[4].groupBy("doc_id").sum("length").toPandas()
    assert sorted(pieces.doc_id) == ids(steps[3])


def test_run_equals_the_stages(spark, steps):
    got, want = (df.toPandas().sort_values(["doc_id", "start"]).reset_index(drop=True) for df in (corpus_pipeline.run(spark, SF), steps[4]))
    pd.testing.assert_frame_equal(got, want)
    assert np.issubdtype(got.ids_crc32.dtype, np.int64)


def test_stages_take_nulls_repeats_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.limit(20)
    odd = some.unionByName(some).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "x", 0)], docs.schema))
    once = corpus_pipeline.near_duplicates(spark, odd, SF)
    assert once.columns == docs.columns and once.where("doc_id is null").count() == 2
    assert once.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        stage(spark, odd, SF).count()


def test_rows_that_share_an_id_or_have_none_are_judged_by_themselves(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(1, "a clean text", "en", "s", 1), (1, leak, "en", "s", 1), (None, leak, "en", "s", 1), (2, "another clean text", "en", "s", 1), (2, None, None, None, None), (None, "en", None, "s", 1), (None, None, "en", "s", 1)]
    df = spark.createDataFrame(rows, docs.schema).withColumn("node", F.lit("clash"))
    left = corpus_pipeline.decontamination(spark, df, SF)
    assert left.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == [(0, ""), (0, "en"), (1, "a clean text"), (2, ""), (2, "another clean text")]
    junk = "".join(chr(0x4E00 + i * 37 % 999) + "#" for i in range(3000))
    odd = docs.unionByName(spark.createDataFrame([(docs.first().doc_id, junk, "en", "s", 1), (None, junk, "en", "s", 1)], docs.schema))
    kept = corpus_pipeline.quality(spark, odd, SF)
    assert junk not in {r.text for r in kept.select("text").collect()}
    assert kept.count() >= 0.9 * corpus_pipeline.quality(spark, docs, SF).count()
