"""Retraining jobs on Spark ML: n-gram TF-IDF with a linear model, and random forests for assessments."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42


def ngram_features(unit: str, sizes: Iterable[int], text_col: str = "text", buckets: int = 1 << 12) -> list:
    """Stages from a text to hashed TF-IDF of its character or word n-grams in ``features``."""
    if unit not in ("char", "word"):
        raise ValueError(f"unknown unit: {unit}")
    stages = [RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"(?s)." if unit == "char" else r"\w+", gaps=False, toLowercase=True)]
    parts = []
    for n in sizes:
        stages += [NGram(n=n, inputCol="_tokens", outputCol=f"_n{n}"), HashingTF(inputCol=f"_n{n}", outputCol=f"_tf{n}", numFeatures=buckets), IDF(inputCol=f"_tf{n}", outputCol=f"_idf{n}")]
        parts.append(f"_idf{n}")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def parts(rows: DataFrame, at_least: int, whole_below: int) -> tuple[DataFrame, DataFrame] | None:
    """(train, test): 80/20 by a seeded split; the whole for both where rows are few; None below ``at_least`` rows."""
    n = rows.count()
    if n < at_least:
        return None
    if n < whole_below:
        return rows, rows
    train, test = rows.randomSplit([0.8, 0.2], SEED)
    return train, test


def train_classifier(rows: DataFrame, unit: str, sizes: Iterable[int], at_least: int, whole_below: int = 10, previous: float = 0.0) -> tuple[PipelineModel | None, dict]:
    """A text classifier on (text, label string) and its report; deployed where its accuracy is no worse than ``previous``."""
    rows = rows.na.drop(subset=["text", "label"])
    split = parts(rows, at_least, whole_below)
    if split is None or rows.select("label").distinct().limit(2).count() < 2:
        return None, {"skipped": True}
    train, test = split
    stages = [StringIndexer(inputCol="label", outputCol="_y", handleInvalid="keep"), *ngram_features(unit, sizes), LogisticRegression(labelCol="_y", featuresCol="features", maxIter=50)]
    model = Pipeline(stages=stages).fit(train)
    accuracy = MulticlassClassificationEvaluator(labelCol="_y", metricName="accuracy").evaluate(model.transform(test))
    return model, {"skipped": False, "accuracy": accuracy, "previous": previous, "deployed": accuracy >= previous}


def ocr_correction(rows: DataFrame, previous: float = 0.0) -> tuple[PipelineModel | None, dict]:
    return train_classifier(rows, "char", (2, 3, 4), 5, previous=previous)


def commentary_classifier(rows: DataFrame, previous: float = 0.0) -> tuple[PipelineModel | None, dict]:
    return train_classifier(rows, "word", (1, 2), 10, 20, previous)


def confidence_regressor(rows: DataFrame) -> tuple[PipelineModel | None, dict]:
    """(text, label double) to a linear model; its mean absolute error is reported and it is always deployed."""
    split = parts(rows.na.drop(subset=["text", "label"]), 10, 20)
    if split is None:
        return None, {"skipped": True}
    model = Pipeline(stages=[*ngram_features("char", (2, 3)), LinearRegression(featuresCol="features", labelCol="label", regParam=0.1)]).fit(split[0])
    error = RegressionEvaluator(labelCol="label", metricName="mae").evaluate(model.transform(split[1]))
    return model, {"skipped": False, "mae": error, "deployed": True}


def assessment(rows: DataFrame, inputs: list[str], label: str, classify: bool, trees: int = 50) -> tuple[PipelineModel, float]:
    """A random forest on numeric columns; (model, accuracy or R2 on a fifth of the rows). Rows with nulls are left out."""
    rows = rows.na.drop(subset=[*inputs, label])
    train, test = rows.randomSplit([0.8, 0.2], SEED)
    forest = (RandomForestClassifier if classify else RandomForestRegressor)(featuresCol="features", labelCol=label, numTrees=trees, seed=SEED)
    model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), forest]).fit(train)
    judge = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy") if classify else RegressionEvaluator(labelCol=label, metricName="r2")
    return model, judge.evaluate(model.transform(test))


def mark_used(feedback: DataFrame, used: DataFrame, key: str = "id") -> DataFrame:
    """Feedback rows with ``used_for_training`` set where their key was handed to a job, also one that skipped."""
    hit = used.select(key).distinct().withColumn("_used", F.lit(True))
    return feedback.join(hit, key, "left").withColumn("used_for_training", F.coalesce("_used", "used_for_training")).drop("_used")


def calibrated(baseline: Column, model: Column) -> Column:
    """Mean of the two confidences; the baseline alone where no model speaks."""
    return F.when(model.isNull(), baseline).otherwise((baseline + model) / 2)
