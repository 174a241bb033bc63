"""Stored models: versions in a folder, the newest loaded by name, its version in every scored row."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions below a folder, ascending; a version whose saving broke off has no mark and doesn't count."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [s.getPath().getName() for s in files.listStatus(root)]
    done = {n.removesuffix(".done") for n in names if n.endswith(".done")}
    return sorted(int(n.removeprefix("v")) for n in done if n in names)


def save(spark: SparkSession, model: PipelineModel, path: str) -> int:
    """Store the model as the next version, then mark it complete; returns the version."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    number = max(versions(spark, path), default=0) + 1
    model.write().overwrite().save(f"{path}/v{number}")
    files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number}.done"), True).close()
    return number


def scored(rows: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """``rows`` (with text) and label, confidence and model_version under a stored classifier.

    The newest version, or the one asked for; where there is none, all three columns are null. A null or blank text has
    no label. Equal versions give equal scores in every session.
    """
    spark = rows.sparkSession
    known = versions(spark, path)
    chosen = version if version is not None else max(known, default=None)
    if chosen not in known:
        return rows.withColumns({"label": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "model_version": F.lit(None).cast("int")})
    model = PipelineModel.load(f"{path}/v{chosen}")
    names = next(s for s in model.stages if isinstance(s, StringIndexerModel)).labels
    judged = PipelineModel([s for s in model.stages if not isinstance(s, StringIndexerModel)]).transform(rows.withColumn("_text", F.col("text")).withColumn("text", F.coalesce("text", F.lit(""))))
    judged = IndexToString(inputCol="prediction", outputCol="_label", labels=[*names, "__unknown"]).transform(judged)
    some = F.coalesce(F.trim(F.col("_text")) != "", F.lit(False))
    return judged.select(*[F.col("_text").alias("text") if c == "text" else F.col(c) for c in rows.columns], F.when(some, F.col("_label")).alias("label"), F.when(some, F.array_max(vector_to_array("probability"))).alias("confidence"), F.lit(chosen).cast("int").alias("model_version"))
