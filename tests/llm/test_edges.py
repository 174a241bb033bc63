"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from docgauge.llm import decontamination, embedding_dedup, html_text, jaccard_join, packing, pii, quality, secret_scan, sharding, toxicity

LONG = " ".join(f"word{i % 997} of line {i}" for i in range(60_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (1, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, "the quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (3, "", "en", None, None),
    (4, None, None, "b", 3),
    (None, "a text without an id, password = abcdefghijkl1234", "fr", "b", 3),
    (5, " \t\n ", "de", "c", 0),
    (6, LONG, "en", "c", len(LONG)),
    (7, "ünï cödé \U0001f600 " * 5, "en", "c", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("id", "n", "shard", "label", "spans", "score", "sig", "rep", "size", "tie", "hilbert", "part", "ids", "base", "g", "positive", "start", "component_id", "held_out")
LABELS = [(1, 1, 1), (2, 1, 0), (3, 1, 0), (6, 1, 0), (7, 1, 0), (None, 1, 1), (1, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(1, "jumps over the lazy dog again and again"), (1, "jumps over the lazy dog again and again"), (2, None), (3, ""), (4, "short"), (None, "word3 of line 3 word4 of line 4 word5 of line 5")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit("clash"))


def test_decontamination(docs, none, bench):
    found = sorted((r.doc_id, r.item_id or 0, r.edits) for r in decontamination.contaminated(docs, bench).collect())
    assert found == [(1, 1, 0), (1, 1, 0), (2, 1, 0), (6, 0, 0)]
    assert decontamination.contaminated(none, bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_html(spark):
    page = "<html><body><article><p>a  b</p><p>c&amp;d</p></article></body></html>"
    rows = [(1, "http://h/1", page), (1, "http://h/1", page), (2, None, None), (3, "not a url", ""), (None, "http://h/2", "<p>x"), (4, "http://h/4", "<article><p>" + LONG + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("id", "row", "host", "text", "open", "at", "shards")})
    out = html_text.main_text(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out) == [(0, "x", 1), (1, "a b c&d", 7), (1, "a b c&d", 7), (2, "", 0), (3, "", 0), (4, LONG, len(LONG))]
    assert html_text.main_text(df.limit(0)).count() == 0


def test_toxicity(docs, none, labels):
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert {r.score for r in toxicity.toxicity_scores(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity_scores(none, labels).count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).count() == len(ROWS)


def test_secrets(docs, none):
    out = {r.doc_id: r for r in secret_scan.find_secrets(docs).collect()}
    assert out[None].n_assign == 1 and [tuple(s) for s in out[None].spans][:1] == [("assign", 22, 49)]
    assert secret_scan.find_secrets(docs).count() == len(ROWS)
    assert out[4].spans == [] and out[3].spans == []
    assert secret_scan.find_secrets(none).count() == 0


def test_redaction_keeps_repeated_and_null_ids(docs):
    out = secret_scan.redacted(docs)
    assert out.columns == docs.columns and out.count() == len(ROWS)
    assert sorted(r.text for r in out.where("doc_id is null").collect()) == ["a text without an id, [SECRET]"]
    assert out.where("doc_id = 1").count() == 2


def test_jaccard(docs, none):
    out = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect())
    assert [(a, c) for a, _, c in out] == [(0, None), (1, 1), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 7)]
    assert [n for a, n, _ in out if a in (3, 4, 5)] == [0, 0, 0]
    assert jaccard_join.jaccard_components(none).count() == 0


def test_quality(docs, none, labels):
    trusted = labels.where("quality = 1").select("doc_id")
    out = quality.perplexities(docs, trusted)
    by = {(r.doc_id, r.lang): r for r in out.collect()}
    assert len(by) == 8 == out.count() and by[3, "en"].perplexity is None and by[3, "en"].kept and by[4, ""].kept
    assert quality.perplexities(none, trusted).count() == 0
    assert all(r.kept for r in quality.perplexities(docs, trusted.limit(0)).collect())


def test_packing(docs, none):
    out = packing.packed(docs, window=64).collect()
    ends = {}
    for r in out:
        ends[r.doc_id] = ends.get(r.doc_id, 0) + r.length
    assert ends[3] == ends[4] == ends[5] == 1 and ends[1] == 2 * ends[2]
    assert packing.packed(none).count() == 0


def test_pii(docs, none):
    out = pii.find_pii(docs)
    assert out.count() == len(ROWS) and out.where("n_email + n_card + n_phone > 0").count() == 0
    assert pii.find_pii(none).count() == 0


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding(docs, none, law):
    run = lambda df: sharding.hilbert_shards(df, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 1, ["lang", "source", "n_chars"], 4, law)
    out = run(docs).collect()
    assert len(out) == len(ROWS)
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert run(none).count() == 0
    with pytest.raises(ValueError, match="unknown law"):
        sharding.hilbert_shards(docs, "doc_id", F.lit(1), ["lang"], 4, "key")


def test_embeddings(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.0, 0.0], 1), (3, [2.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 2), (5, [1.0, 0.0, 0.0], None), (6, None, 1), (7, [], 1),
        (8, [0.0, 0.0, 0.0], 1), (9, [nan, 1.0, 0.0], 1), (10, [None, 1.0, 0.0], 1), (11, [inf, 0.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [1.0], 1), (14, [3.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("clash") for c in ("id", "v", "vec", "copies", "cell", "use", "n_links")})
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert out[1] == (2, 1, True) and out[2] == (2, 1, False) and out[3] == (2, 1, False) and out[13] == (1, 13, True) and out[14] == (1, 13, False)
    assert all(out[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_word_counts_hold_few_words_within_a_batch(monkeypatch):
    """A batch of many rows is counted in slices, so that a task never holds more words than the bound and one slice's."""
    from collections import Counter

    import pyarrow as pa

    from docgauge.llm import quality

    monkeypatch.setattr(quality, "COUNTED", 500)
    texts = [f"a b{i} c{i} d{i % 7}" for i in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["x"] * 3000), pa.array(texts)], names=["lang", "text"])
    out = list(quality.word_counts(iter([batch])))
    assert max(b.num_rows for b in out) <= 500 + 4 * 200
    total = Counter()
    for b in out:
        for w, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            total[w] += n
    assert total == Counter(w for t in texts for w in t.split())
