"""Hilbert-curve ordering: quantise metadata, sort by curve index, cut the order into shards.

Rows that are near in several metadata columns at once get neighbouring curve indexes, so a file cut from the order
spans a narrow range of every column and can be skipped by any of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from docgauge.llm._common import stored

BITS = 5


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of integer points, shape (n, dims), by Skilling's transform (AIP Conf. Proc. 707, 2004)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= fix
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> level) & 1)
    return out


def quantised(df: DataFrame, columns: list[str], bits: int = BITS) -> list[Column]:
    """A cell of 0..2**bits-1 per column: numbers by approximate quantiles over all rows, other types by hash; null is 0.

    At most 2**bits - 1 cut points a column reach the driver, whatever the input's size.
    """
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    cuts: dict[str, list] = {}
    if numeric:
        at = [i / 2**bits for i in range(1, 2**bits)]
        row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 1000).alias(f"q{i}") for i, c in enumerate(numeric)]).first()
        cuts = {c: row[f"q{i}"] or [] for i, c in enumerate(numeric)}

    def cell(c: str) -> Column:
        if c not in numeric:
            return F.when(F.col(c).isNull(), 0).otherwise(F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(2**bits))).cast("int")
        bounds = sorted(set(cuts[c]))
        above = F.array(*[F.lit(float(v)) for v in bounds]) if bounds else F.array().cast("array<double>")
        return F.when(F.col(c).isNull(), 0).otherwise(F.size(F.filter(above, lambda v: v < F.col(c).cast("double")))).cast("int")

    return [cell(c) for c in columns]


def hilbert_shards(df: DataFrame, id_col: str, size: Column, columns: list[str], shards: int = 16, law: str = "rows", tie: Column | None = None, bits: int = BITS) -> DataFrame:
    """Order rows along the curve and cut ``shards`` runs; returns id, size, ``tie``, hilbert, shard and slot.

    law "rows": counts differ by one at most. law "bytes": cuts lie where the running size passes k/shards of the
    total, so sizes differ by about one row's size. Ties on the curve are ordered by ``tie`` (equal texts stay side by
    side) and then id, so a hot value is spread over as many range partitions as it needs. Nulls sort first and quantise
    to cell 0, repeated rows are kept as rows, an empty table gives no rows; other columns of ``df`` are ignored.
    The order is range-partitioned and stored; only one sum per partition and one count per shard are combined.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"unknown law: {law}")
    cells = quantised(df, columns, bits)

    @F.pandas_udf("long")
    def curve(points: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index(points.to_numpy(), bits))

    keyed = df.select(F.col(id_col).alias("id"), size.cast("long").alias("size"), (F.lit(0) if tie is None else tie).cast("long").alias("tie"), *[c.alias(f"d{i}") for i, c in enumerate(cells)])
    keyed = keyed.select("id", "size", "tie", curve(F.struct(*[f"d{i}" for i in range(len(cells))])).alias("hilbert"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(keyed.repartitionByRange(parts, "hilbert", "tie", "id").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("part").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range partition
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"))
    total = sums.agg(F.sum("n").alias("rows"), F.sum("b").alias("bytes")).first()
    run = Window.partitionBy("part").orderBy("hilbert", "tie", "id", "size")
    placed = dealt.join(F.broadcast(offsets), "part")  # as many rows as shuffle partitions
    placed = placed.withColumn("nth", F.col("n0") + F.row_number().over(run) - 1)
    placed = placed.withColumn("upto", F.col("b0") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    rows, volume = total["rows"] or 1, total["bytes"] or 1
    middle = F.col("upto") - F.col("size") / 2
    shard = F.floor(F.col("nth") * shards / F.lit(rows)) if law == "rows" else F.floor(middle * shards / F.lit(volume))
    placed = placed.withColumn("shard", F.least(shard, F.lit(shards - 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("nth").alias("first"))
    return placed.join(F.broadcast(first), "shard").select("id", "size", "tie", "hilbert", "shard", (F.col("nth") - F.col("first")).alias("slot"))


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts along a curve over lang, source and n_chars."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    out = hilbert_shards(docs, "doc_id", F.octet_length(text) + 1, ["lang", "source", "n_chars"], 16, "rows", F.crc32(text.cast("binary")))
    return out.select(F.col("id").alias("doc_id"), "size", F.col("tie").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")
