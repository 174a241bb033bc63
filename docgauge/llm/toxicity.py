"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., NeurIPS 2017) over word and affix counts."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm._common import forget, stored, trimmed

#: Bounds of the training sample (rows) and of the feature set.
POSITIVES, UNLABELLED, FEATURES = 4000, 12000, 768
FOLDS = 5
CACHE = 500_000


def features(token: str) -> list[str]:
    """The token in lower case without outer punctuation, and its beginnings and endings."""
    w = token.lower().strip(string.punctuation)
    n = len(w)
    return ["=" + w, *["^" + w[:k] for k in (4, 5, 6) if n > k], *["$" + w[-k:] for k in (4, 5) if n > k]] if w else []


def feature_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, texts of positives, texts of unlabelled) that hold it, summed within a partition."""
    seen = (Counter(), Counter())
    for batch in batches:
        for positive, text in zip(batch.column("positive").to_pylist(), batch.column("text").to_pylist(), strict=True):
            seen[positive].update({f for w in set((text or "").split()) for f in features(w)})
    names = sorted(seen[0].keys() | seen[1].keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())], names=["feature", "p", "u"])


class Counts:
    """Counts of chosen features in texts; a token's features are looked up once."""

    def __init__(self, chosen: list[str]):
        self.index = {f: i for i, f in enumerate(chosen)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature, occurrences) of all features that occur, by text and feature."""
        if len(self.known) > CACHE:
            self.known.clear()
        known, flat, size = self.known, [], []
        for text in texts:
            tokens = (text or "").split()
            for w in set(tokens).difference(known):
                known[w] = tuple(self.index[f] for f in features(w) if f in self.index)
            at = list(chain.from_iterable(map(known.__getitem__, tokens)))
            flat += at
            size.append(len(at))
        key, n = np.unique(np.repeat(np.arange(len(texts)), size) * max(len(self.index), 1) + np.array(flat, np.int64), return_counts=True)
        return key // max(len(self.index), 1), key % max(len(self.index), 1), n


def risk(w: np.ndarray, b: float, x: np.ndarray, positive: np.ndarray, prior: float, decay: float = 0.0) -> tuple[float, float]:
    """(prior * E_P[l(f)], E_U[l(-f)] - prior * E_P[l(-f)]) under the logistic loss; the decay's term is in the first."""
    fp, fu = x[positive == 1] @ w + b, x[positive == 0] @ w + b
    soft = lambda z: np.logaddexp(0, z).mean()
    return prior * soft(-fp) + decay / 2 * float(w @ w), soft(fu) - prior * soft(fp)


def gradient(w: np.ndarray, b: float, x: np.ndarray, positive: np.ndarray, prior: float, decay: float, slack: float = 0.0) -> np.ndarray:
    """Of the risk by weights and shift; where the second part is below -slack, of its negative alone, as in the paper."""
    xp, xu = x[positive == 1], x[positive == 0]
    sp, su = (1 / (1 + np.exp(-np.clip(m @ w + b, -30, 30))) for m in (xp, xu))
    sign = 1.0 if risk(w, b, x, positive, prior)[1] >= -slack else -1.0
    dp = (-prior * (1 - sp) if sign > 0 else 0.0) / len(xp) - sign * prior * sp / len(xp)
    du = sign * su / len(xu)
    return np.concatenate([xp.T @ dp + xu.T @ du + decay * w, [dp.sum() + du.sum()]])


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, rounds: int = 400, rate: float = 0.02, decay: float = 1e-3, slack: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and shift of a linear classifier under the class-prior-corrected, non-negative logistic risk.

    Risk: prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)]). Where the bracket falls below -slack, its
    gradient is followed upwards instead, as in the paper.
    """
    w, b = np.zeros(x.shape[1]), np.log(prior / (1 - prior))
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        g = gradient(w, b, x, positive, prior, decay, slack)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED, chosen: int = FEATURES) -> DataFrame:
    """One row per input row: id, held_out, score in [0, 1], predicted.

    Labels of rows with crc32(id as text) mod 5 = 0 are never read. Confirmed positives and unlabelled texts are sampled
    by hash, at most about ``positives`` and ``unlabelled`` rows (documented bounds; the prior uses all training
    labels). Whole texts are scored. A null or empty text has no features and gets the shift's probability; a null id is
    not held out; an id with several labels is positive if one says so. Without any positive label the score is 0.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    held = lambda c: F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").where(~held(F.col("id")))
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    counted = marks.agg(F.count("*").alias("n"), F.sum("y").alias("k")).first()
    total = base.count()
    if not counted["k"] or not total:
        return base.select(F.col("id").alias(id_col), held(F.col("id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    prior = min(0.9, max(0.005, counted["k"] / counted["n"]))
    sure = marks.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(positives).select("id", F.lit(1).alias("positive"))
    sample = base.join(F.broadcast(sure), "id")  # at most `positives` rows
    share = max(1, -(-total // unlabelled))
    pool = base.where(~held(F.col("id"))).where(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(share)) == 0).withColumn("positive", F.lit(0))
    sample = stored(sample.select("id", "text", "positive").unionByName(pool.select("id", "text", "positive")))
    n = {r["positive"]: r["n"] for r in sample.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return base.select(F.col("id").alias(id_col), held(F.col("id")).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    found = sample.mapInArrow(feature_frequencies, "feature string, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p >= 3")
    odds = F.log((F.col("p") + 0.5) / (n[1] + 1)) - F.log((F.col("u") + 0.5) / (n[0] + 1))
    z = odds / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("u") + 0.5))
    names = [r["feature"] for r in found.select("feature", z.alias("z")).orderBy(F.desc("z"), "feature").limit(chosen).collect()]
    counts = Counts(names)

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, at, n = counts(batch.column("text").to_pylist())
            cuts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("positive"), *(pa.ListArray.from_arrays(cuts, pa.array(v, pa.int32())) for v in (at, n))], names=["positive", "at", "n"])

    rows = sample.select("positive", "text").mapInArrow(trimmed(matrix), "positive int, at array<int>, n array<int>").collect()
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, r in enumerate(rows):
        x[i, r["at"]] = np.log1p(r["n"])
    w, b = fit_nnpu(x, np.array([r["positive"] for r in rows]), prior)
    forget(sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            row, at, n = counts(batch.column("text").to_pylist())
            z = b + np.bincount(row, w[at] * np.log1p(n), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["id", "score"])

    out = base.mapInArrow(trimmed(score), "id long, score double")
    return out.select(F.col("id").alias(id_col), held(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity_scores(docs, labels)
