"""A training-corpus pipeline over ``documents``: quality, near duplicates, decontamination, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm._common import forget, stored, without
from docgauge.llm.decontamination import contaminated
from docgauge.llm.jaccard_join import jaccard_components
from docgauge.llm.packing import packed
from docgauge.llm.quality import perplexities
from docgauge.llm.secret_scan import redacted


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a 64-bit name of each row's id, language and text, and that column's name.

    Stages decide on texts, so they drop rows by this name: rows that share an id are documents of their own, rows
    without one too, and rows that are equal in all three share their fate.
    """
    name = "node"
    while name in docs.columns:
        name += "_"
    parts = [c for n in ("doc_id", "lang", "text") for c in (F.col(n).isNull(), F.col(n))]
    return docs.withColumn(name, F.xxhash64(*parts)), name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose perplexity under trusted text is beyond their language's threshold.

    Null, empty and blank texts stay, as do texts of a language without trusted text; a row without id is judged but
    never trusted; of rows that share an id each is judged by itself. An empty table stays empty.
    """
    rows, node = numbered(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = rows.select("doc_id", node).join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id").select(node)
    scores = perplexities(rows, trusted, node)
    return without(rows, stored(scores.where("not kept").select(node).distinct()), [node]).select(*docs.columns)


#: Links of the near-duplicate stage; the contract's three words and 90/100 are those of the query op5_jaccard_join.
NEAR = {"words": 5, "num": 80, "den": 100}


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the smallest doc_id of each component of linked documents; null ids stay.

    Rows that repeat a doc_id are documents of their own: they fold where their texts are equal (null texts too) or linked.
    """
    named = docs.where("doc_id is not null")
    if named.groupBy("doc_id").count().where("count > 1").limit(1).count() == 0:
        parts = jaccard_components(docs, **NEAR)
        return without(docs, stored(parts.where("doc_id <> component_id").select("doc_id")), ["doc_id"]).select(*docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = named.groupBy("doc_id", "text").agg(F.min(F.struct("doc_id", *rest)).alias("r")).select("doc_id", "text", *[F.col(f"r.{c}").alias(c) for c in rest])
    rows = stored(rows.orderBy("doc_id", F.xxhash64("text"), "text").withColumn("node", F.monotonically_increasing_id()))
    parts = jaccard_components(rows, "node", **NEAR)
    kept = without(rows, stored(parts.where("node <> component_id").select("node")), ["node"]).select(*docs.columns)
    return kept.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark passage, whatever their id, and no other row of that id.

    Null and empty texts hold none; benchmark items that are null, empty or too short match nothing. An empty table on
    either side drops nothing.
    """
    rows, node = numbered(docs)
    found = contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=node)
    return without(rows, stored(found.select(node).distinct()), [node]).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every found secret in the texts by a mark; rows, ids and their repeats stay as they are, null texts null."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens, as pieces with a checksum of their ids.

    A null or empty text is one token, the end; repeated rows and rows without an id are packed as rows of their own, and
    pieces carry the id as it is. An empty table gives no pieces.
    """
    return packed(docs, digest=True)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", packing),
]

#: SQL can't express the language model, the network or the packing; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each stage's result is written as Parquet and read again by the next."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return docs
