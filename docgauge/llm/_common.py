"""Helpers shared by the training-data operators: shared scratch tables, connected components, small guards."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Batches = Iterator[pa.RecordBatch]


def trimmed(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow; at its end the worker, which outlives the task, gives freed memory back to the system."""

    def trimming(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            del batches
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # no glibc
                pass

    return trimming


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a folder of our own only in local mode, where none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        base = tempfile.mkdtemp(prefix="docgauge-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/t-{uuid.uuid4().hex}"


#: Spark's own setting to delete a query's shuffle files when it ends instead of when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage and survives lost executors.

    The shuffle files of the write go with it, as nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` made and nothing will read again."""
    spark = df.sparkSession
    for root in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a narrow id table up to which it is broadcast.
BROADCAST_ROWS = 2_000_000


def without(df: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in the stored table ``gone``; nulls in the key match nothing and stay.

    The ids are broadcast only up to ``BROADCAST_ROWS``; beyond that both sides are shuffled.
    """
    return df.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, on, "left_anti")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest reachable id per node of an undirected edge list, as rows (id, component_id).

    Contraction: every node hooks to its least neighbour (a minimum, pre-aggregated before the shuffle), pointers are
    doubled until they reach roots, edges are renamed to roots and the distinct ones that are left go into the next
    round, so a round halves the nodes at least and a star takes one. Every round writes its tables to the shared
    folder. Null ends and self loops are ignored; an empty input gives no rows.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    cur = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while labels is None or cur.limit(1).count():
        ends = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(ends.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).withColumnRenamed("a", "id"))
        while True:
            up = parent.select(F.col("id").alias("up"), F.col("m").alias("top"))
            jumped = stored(parent.join(up, parent.m == up.up).select("id", F.col("top").alias("m"), (F.col("top") != F.col("m")).alias("moved")))
            moved = jumped.where("moved").limit(1).count()
            forget(parent)
            parent = jumped.drop("moved")
            if not moved:
                break
        new = parent if labels is None else labels.join(parent.select(F.col("id").alias("m"), F.col("m").alias("n")), "m", "left").select("id", F.coalesce("n", "m").alias("m"))
        new = stored(new.select("id", "m"))
        name = parent.select(F.col("id").alias("k"), F.col("m").alias("r"))
        moved_edges = cur.join(name, cur.a == name.k).select(F.col("r").alias("a"), "b").join(name, F.col("b") == name.k).select("a", F.col("r").alias("b"))
        nxt = stored(moved_edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        for t in (cur, parent, *([labels] if labels is not None else [])):
            forget(t)
        cur, labels = nxt, new
    forget(cur)
    return labels.withColumnRenamed("m", "component_id")
