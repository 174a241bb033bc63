"""Exact integer k-means whose assignment rounds skip scans by Hamerly's bounds (Hamerly, SDM 2010).

Every vector keeps one upper bound of the distance to its centroid and one lower bound of the distance to the second
nearest. After centroids moved, the upper bound grows by the drift of the vector's own centroid and the lower bound
shrinks by the largest drift of any other. A vector whose upper bound is still below the lower one, or below half the
way to the next centroid, keeps its cluster; the others get their exact distance, and if that does not decide, a full
scan in integers. Bounds are rounded outwards, so they never decide a tie.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm._common import Batches, forget, stored, trimmed

#: Rows worked on at a time.
STEP = 2048
#: Components of more than 2**27 steps are refused: 64 squared differences of such would pass a 64-bit integer.
LARGEST = 2**27
UP, DOWN = 1 + 1e-12, 1 - 1e-12


def squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, (n, dims) by (k, dims) to (n, k)."""
    return np.stack([((q - row) ** 2).sum(1) for row in c], 1) if len(c) else np.zeros((len(q), 0), np.int64)


def drifts(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid moved, and the farthest move of any other one, both rounded up."""
    moved = np.sqrt(((old - new) ** 2).sum(1)) * UP
    rest = np.where(np.eye(len(moved), dtype=bool), 0.0, moved[None]).max(1)
    return moved, rest


def assign(centroids: np.ndarray, before: np.ndarray | None, measure: bool):
    """One assignment round over rows (id, q, near, upper, lower, scans); ``before`` is None where no bounds exist yet.

    With ``measure`` the column distance holds the exact squared distance of every row.
    """
    apart = np.sqrt(squared(centroids, centroids)) * DOWN
    np.fill_diagonal(apart, np.inf)
    half = apart.min(1) / 2
    moved, rest = (None, None) if before is None else drifts(before, centroids)

    def run(batches: Batches) -> Batches:
        for batch in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            flat = batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            q = flat.reshape(batch.num_rows, -1)
            near, scans = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("near", "scans"))
            if before is None:
                upper, lower, open_ = np.zeros(len(q)), np.zeros(len(q)), np.arange(len(q))
            else:
                upper = batch.column("upper").to_numpy(zero_copy_only=False) * UP + moved[near]
                lower = batch.column("lower").to_numpy(zero_copy_only=False) * DOWN - rest[near]
                bound = np.maximum(half[near], lower)
                open_ = np.flatnonzero(upper >= bound)
                upper[open_] = np.sqrt(((q[open_] - centroids[near[open_]]) ** 2).sum(1)) * UP
                open_ = open_[upper[open_] >= bound[open_]]
            d = squared(q[open_], centroids)
            near[open_] = d.argmin(1)  # the first of equals is the smaller number
            scans[open_] += 1
            upper[open_] = np.sqrt(d[np.arange(len(d)), near[open_]]) * UP
            d[np.arange(len(d)), near[open_]] = np.iinfo(np.int64).max
            lower[open_] = np.sqrt(d.min(1)) * DOWN
            distance = ((q - centroids[near]) ** 2).sum(1) if measure else np.zeros(len(q), np.int64)
            columns = [batch.column("id"), batch.column("q"), *(pa.array(v) for v in (near.astype(np.int32), upper, lower, scans.astype(np.int32), distance))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "q", "near", "upper", "lower", "scans", "distance"])

    return trimmed(run)


def integer_clusters(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, dims: int = 64, rounds: int = 3, scale: int = 64, seed: str = "1") -> DataFrame:
    """One row per kept vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256, scans.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; a component x becomes floor(scale * x).
    Components beyond ``LARGEST`` after scaling are refused like non-finite ones, as distances would not fit 64 bits.
    Centroids 0, 1, ... start as the ``k`` kept vectors with the least sha256 of "seed:id"; null ids come last, ties go
    by the vector; fewer vectors give fewer centroids. ``rounds`` times every vector goes to the nearest centroid (ties:
    the smaller number) and non-empty centroids become floor(sum / count); then vectors are assigned once more.
    Repeated rows and ids are vectors of their own, an empty table gives no rows, other columns are ignored.
    ``scans`` counts the full scans of a vector (1 to ``rounds`` + 1). Each round's bounds are a table in the shared
    folder; sums are partial before the shuffle, and only ``k`` centroids pass through the driver.
    """
    spark = df.sparkSession
    v = F.col("v")
    scaled = lambda x: F.floor(x * F.lit(float(scale)))
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST / scale))
    kept = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.coalesce((F.size("v") == dims) & fits, F.lit(False)))
    kept = kept.select("id", F.transform(v, lambda x: scaled(x).try_cast("int")).alias("q"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(name.asc_nulls_last(), "q").limit(k).collect()
    result = f"{id_col} {df.schema[id_col].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, scans int"
    if not first:
        return spark.createDataFrame([], result)
    centroids, before = np.array([r["q"] for r in first], np.int64), None
    schema = f"id {df.schema[id_col].dataType.simpleString()}, q array<int>, near int, upper double, lower double, scans int, distance long"
    state = kept.select("id", "q", F.lit(0).alias("near"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"), F.lit(0).alias("scans"))
    for r in range(rounds + 1):
        done = state.mapInArrow(assign(centroids, before, r == rounds), schema)
        done = stored(done.drop("distance") if r < rounds else done.drop("q", "upper", "lower"))
        if r:
            forget(state)
        state, before = done, centroids
        if r < rounds:
            sums = state.groupBy("near").agg(F.count("*").alias("n"), *[F.sum(F.element_at("q", i + 1).cast("long")).alias(f"s{i}") for i in range(dims)]).collect()  # k rows
            centroids = centroids.copy()
            for row in sums:
                centroids[row["near"]] = [row[f"s{i}"] // row["n"] for i in range(dims)]
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = state.groupBy("near").agg(exact.cast("long").alias("cluster_inertia")).join(spark.createDataFrame(digests, "near int, centroid_sha256 string"), "near")
    per = per.withColumn("inertia", F.lit(state.agg(exact.cast("long")).first()[0]))
    out = state.join(F.broadcast(per), "near")  # at most k rows
    return out.select(F.col("id").alias(id_col), F.col("near").alias("cluster"), "distance", "cluster_inertia", F.col("inertia").cast("long").alias("inertia"), "centroid_sha256", "scans")


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of all 64-component embeddings after three rounds."""
    return integer_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("scans")


def _round(r: int) -> str:
    """SQL of one round: assignment a{r} to centroids c{r}, and centroids c{r+1}."""
    return f"""
d{r} as (select v.row, v.q, c.num, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as dist from v cross join c{r} c
), a{r} as (select row, any_value(q) as q, arg_min(num, (dist, num)) as num, min(dist) as dist from d{r} group by row
), u{r} as (select num, i, sum(q[i])::bigint as s, count(*) as n from a{r}, range(1, 65) t(i) group by num, i
), m{r} as (select num, list((s - ((s % n) + n) % n) // n order by i) as q from u{r} group by num
), c{r + 1} as (select c.num, coalesce(m.q, c.q) as q from c{r} c left join m{r} m using (num)"""


#: DuckDB SQL for the rows of op11_centroid_clusters, without bounds.
ORACLE_SQL = f"""
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (
  select row_number() over (order by sha256('1:' || vec_id)) - 1 as num, q from v order by sha256('1:' || vec_id) limit 16
), {"), ".join(_round(r).strip() for r in range(3))}
), d3 as (select v.row, c.num, c.q, list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as dist from v cross join c3 c
), a3 as (select row, arg_min(num, (dist, num)) as num, arg_min(q, (dist, num)) as q, min(dist) as dist from d3 group by row)
select vec_id, num::integer as cluster, dist as distance, (sum(dist) over (partition by num))::bigint as cluster_inertia, (sum(dist) over ())::bigint as inertia,
  sha256(array_to_string(a3.q, ',')) as centroid_sha256
from a3 join v using (row)
"""
