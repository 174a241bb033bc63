"""File matching within a batch: by order id, then by the best name score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgauge.functions.text import match_key, match_score


def by_order_id(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, match_id) of the first right file, by id, with the same batch and order id. Columns: id, batch_id, order_id."""
    pairs = left.join(right.select("batch_id", "order_id", F.col("id").alias("match_id")), ["batch_id", "order_id"])
    return pairs.groupBy("id").agg(F.min("match_id").alias("match_id"))


def by_name(left: DataFrame, right: DataFrame, at_least: int = 2) -> DataFrame:
    """(id, match_id, score) of the best-scored right file of the same batch, the first by id among equals.

    Batches are bounded uploads (a thousand entries), so candidates are those of one batch; hidden files don't count.
    """
    a = left.select("batch_id", "id", match_key(F.col("filename")).alias("k"))
    b = right.where("filename is not null and not startswith(filename, '._')").select("batch_id", F.col("id").alias("match_id"), match_key(F.col("filename")).alias("m"))
    scored = a.join(b, "batch_id").select("id", "match_id", match_score(F.col("k"), F.col("m")).alias("score")).where(F.col("score") >= at_least)
    first = Window.partitionBy("id").orderBy(F.desc("score"), "match_id")
    return scored.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, match_id): order id first, the name score only for what that leaves."""
    direct = by_order_id(left, right)
    rest = by_name(left.join(direct, "id", "left_anti"), right).select("id", "match_id")
    return direct.unionByName(rest)


def triples(files: DataFrame) -> DataFrame:
    """Each appraisal with its optional letter and contract; hidden files are left out, unmatched appraisals stay."""
    shown = files.where("filename is not null and not startswith(filename, '._')")
    main = shown.where("file_type = 'APPRAISAL'")
    letters, contracts = (matched(main, shown.where(F.col("file_type") == t)).withColumnRenamed("match_id", n) for t, n in (("ENGAGEMENT", "letter_id"), ("CONTRACT", "contract_id")))
    return main.join(letters, "id", "left").join(contracts, "id", "left")
