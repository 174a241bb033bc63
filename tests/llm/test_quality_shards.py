"""A model of several shards scores as one of a single shard does."""

import math

from docgauge.llm import quality


def test_shards_give_what_one_table_gives(spark):
    words = ["straße", "Häuser", "naïve", "über", "中文字", "\U0001f600\U0001f601", "the", "model", "x1y2", "a"]
    rows = [(i, ("de", "en")[i % 2], " ".join(words[(i * j) % len(words)] + str(j % 3) for j in range(1, 12))) for i in range(60)] + [(60, "en", None), (61, "de", " ")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    trusted = docs.where("doc_id % 3 <> 0").select("doc_id")
    one, many = ({r.doc_id: r for r in quality.perplexities(docs, trusted, shard_rows=n).collect()} for n in (10**6, 100))
    assert one.keys() == many.keys() and len(one) == 62 and one[0].perplexity > 1
    for i, r in one.items():
        assert (r.lang, r.kept, r.perplexity is None) == (many[i].lang, many[i].kept, many[i].perplexity is None)
        assert r.perplexity is None or math.isclose(r.perplexity, many[i].perplexity, rel_tol=1e-9) and math.isclose(r.threshold, many[i].threshold, rel_tol=1e-9)
