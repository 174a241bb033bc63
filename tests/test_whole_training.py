"""The stored model is of all labelled documents and of their whole texts."""

from docgauge.plans import keeping_queries, training


def tables(spark, path, texts):
    """Documents of the texts, in turn of quality 0 and 1."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(len(texts))], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")


def test_words_far_into_a_text_count(spark, tmp_path):
    tables(spark, tmp_path, ["plain " * 400 + ("stock phrase", "sold homes")[i % 2] for i in range(60)])
    got = {r.label: r.n for r in keeping_queries.stored_model_scores(spark, str(tmp_path)).collect()}
    assert got == {"CANNED": 30, "SPECIFIC": 30}


def test_every_labelled_document_is_fitted(spark, tmp_path, monkeypatch):
    tables(spark, tmp_path, [f"text {i}" for i in range(2100)])
    seen = []
    monkeypatch.setattr(training, "commentary_classifier", lambda rows: (seen.append(rows.count()), (None, {}))[1])
    assert [r.n for r in keeping_queries.stored_model_scores(spark, str(tmp_path)).collect()] == [2100] and seen == [2100]
