"""Near-duplicate vectors through an inverted multi-index (Babenko and Lempitsky, 2012).

Each half of a unit vector has its own codebook; the pair of codes names a cell of the product grid. A vector visits
cells in the order of the multi-sequence traversal. Cosine t between unit vectors means squared distance 2 - 2t, split
between the halves, and half i of a partner coded c lies beyond the bisector of c and the nearest centroid, so the
squared bisector distances of both halves add up to a lower bound. Traversal stops when the bound passes the radius:
recall 1 by construction. ``target_recall`` below 1 shrinks the radius that is walked and so the number of cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.llm._common import connected_components, forget, stored, trimmed

SAMPLE = 8192
BLOCK = 1024
SLACK = 1e-6
#: Vectors a cell aims at (over all labels) and rows worked on at a time.
CELL, STEP = 4096, 512


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Lloyd's centroids; empty cells keep their place."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = (-2 * x @ c.T + (c * c).sum(1)).argmin(1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def codebooks(sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    half = sample.shape[1] // 2
    return kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)


def _codes(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid per row, and per row and centroid the squared distance to the bisector with the nearest one."""
    d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
    near = d.argmin(1)
    apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(-1), 1e-30))[near]
    gap = np.maximum((d - d[np.arange(len(x)), near][:, None]) / (2 * apart) - SLACK, 0)
    gap[np.arange(len(x)), near] = 0
    return near, gap**2


def multi_sequence(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], radius2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own cell per row, then the (row, cell) visits in ascending order of the bound, up to ``radius2``."""
    half = len(books[0][0])
    (a, ga), (b, gb) = _codes(x[:, :half], books[0]), _codes(x[:, half:], books[1])
    width = len(books[1])
    rows, cells = [], []
    for i in range(len(x)):
        u, v = np.flatnonzero(ga[i] <= radius2), np.flatnonzero(gb[i] <= radius2)
        bound = ga[i][u][:, None] + gb[i][v][None]
        seen = np.flatnonzero(bound.ravel() <= radius2)
        seen = seen[np.argsort(bound.ravel()[seen], kind="stable")]
        rows.append(np.full(len(seen), i))
        cells.append(u[seen // len(v)] * width + v[seen % len(v)])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return a * width + b, join(rows), join(cells)


def unit_rows(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row positions, double matrix of unit vectors) of equally long vectors without null parts, finite, not zero."""
    flat = np.asarray(values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    x = flat.reshape(len(values), -1)
    norm = np.sqrt((x * x).sum(1))
    return x, norm


def link_blocks(threshold: float):
    """For one group: the visitors of one block against the members of one block of a cell."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        q, m = block[block["visits"]], block[~block["visits"]]
        if q.empty or m.empty:
            return pd.DataFrame({"id": [], "n": [], "root": []}).astype("int64")
        x, y = (np.stack(t["vec"].to_numpy()).astype(np.float64) for t in (q, m))
        cos = (x @ y.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((y * y).sum(1))[None]
        near = np.abs(cos - threshold) < 1e-9
        for i, j in zip(*np.nonzero(near), strict=True):  # order of summation matters only here
            cos[i, j] = float(np.dot(x[i], y[j])) / (float(np.sqrt(np.dot(x[i], x[i]))) * float(np.sqrt(np.dot(y[j], y[j]))))
        qi, mi, weight = q["id"].to_numpy(), m["id"].to_numpy(), m["copies"].to_numpy()
        link = (cos >= threshold) & (qi[:, None] != mi[None])
        n = link @ weight
        label = np.concatenate([qi, mi]).astype(np.int64)
        while True:  # least id of each linked part of the block: a forest, not all pairs
            top, low = label[: len(qi)], label[len(qi) :]
            big = np.iinfo(np.int64).max
            t2 = np.minimum(top, np.where(link, low[None], big).min(1))
            l2 = np.minimum(low, np.where(link, t2[:, None], big).min(0))
            if (t2 == top).all() and (l2 == low).all():
                break
            label = np.concatenate([t2, l2])
        ids, counts = np.concatenate([qi, mi]), np.concatenate([n, np.zeros(len(mi), np.int64)])
        out = pd.DataFrame({"id": ids, "n": counts, "root": label})
        return out[(out["n"] > 0) | (out["root"] != out["id"])]

    return run


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, target_recall: float = 1.0, cells_per_half: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept. Links join vectors of one label with cosine >= threshold.

    Vectors that are null, empty, zero or hold null or non-finite parts, and those with a null label, link with
    nothing; lengths never mix. Equal vectors are folded into one representative with a count before the search, so a
    hot vector costs one row; cells and visitors are dealt in blocks of about ``BLOCK`` rows, and a block pair returns
    counts and a spanning forest, never its pairs. Codebooks are fitted on at most ``sample`` vectors (a bounded
    sample); every vector is indexed. Repeated ids are treated as separate rows only if their vectors differ in
    nothing: an id that repeats counts its copies as links. Empty tables give no rows; other columns are ignored.
    """
    spark = df.sparkSession
    base = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    ok = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    usable = base.where(F.coalesce(ok, F.lit(False)))
    folded = stored(usable.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    seen = folded.orderBy(F.xxhash64("v"), "id").select("v").limit(sample).collect()
    total = folded.count()
    k = cells_per_half or int(np.clip(round((total / CELL) ** 0.5), 2, 256))
    by_dim: dict[int, list] = {}
    for r in seen:
        by_dim.setdefault(len(r["v"]), []).append(r["v"])
    books = {}
    for d, rows in by_dim.items():
        x = np.array(rows)
        with np.errstate(over="ignore", invalid="ignore"):
            x = x / np.sqrt((x * x).sum(1))[:, None]
        if d > 1 and np.isfinite(x).all():
            books[d] = codebooks(x, k)
    radius2 = (2 - 2 * threshold) * min(1.0, max(target_recall, 0.0)) + SLACK

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, STEP) for b in batches for i in range(0, b.num_rows, STEP)):
            vs = batch.column("v")
            dims = pa.compute.list_value_length(vs).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x, norm = unit_rows(vs.take(pa.array(at)))
                if d in books:
                    own, rows, cells = multi_sequence(x / norm[:, None], books[d], radius2)
                else:
                    own, rows, cells = np.zeros(len(at), np.int64), np.arange(len(at)), np.zeros(len(at), np.int64)
                take, cell = np.concatenate([np.arange(len(at)), rows]), np.concatenate([own, cells])
                part = batch.take(pa.array(at[take]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), pa.array(np.full(len(take), d), pa.int32()), pa.array(cell, pa.int64()), pa.array(np.arange(len(take)) >= len(at)), part.column("id"), part.column("copies"), part.column("v")],
                    names=["label", "dim", "cell", "visits", "id", "copies", "vec"],
                )

    visits = stored(folded.mapInArrow(trimmed(visit), f"label string, dim int, cell long, visits boolean, id long, copies long, vec {df.schema[vec_col].dataType.simpleString()}"))
    key = ["label", "dim", "cell"]
    sizes = visits.groupBy(*key).agg(F.sum((~F.col("visits")).cast("long")).alias("m"), F.sum(F.col("visits").cast("long")).alias("q")).where("m > 0")
    sizes = sizes.select(*key, F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / BLOCK).cast("int").alias("qb"))
    dealt = visits.join(sizes, key)
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = dealt.where("not visits").select(*key, mine("mb").alias("i"), each("qb").alias("j"), "visits", "id", "copies", "vec")
    queries = dealt.where("visits").select(*key, each("mb").alias("i"), mine("qb").alias("j"), "visits", "id", "copies", "vec")
    found = stored(members.unionByName(queries).groupBy(*key, "i", "j").applyInPandas(link_blocks(threshold), "id long, n long, root long"))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("id <> root"), "id", "root")
    reps = folded.join(counts, "id", "left").join(parts, "id", "left")
    reps = reps.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    rows = base.withColumn("use", F.when(F.coalesce(ok, F.lit(False)), F.col("label")))
    out = rows.join(reps.withColumnRenamed("label", "use"), ["use", "v"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    result = stored(out)
    for t in (visits, found, folded):
        forget(t)
    return result.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against every vector of its label, cosine >= 0.98."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: DuckDB SQL for the rows of op10_embedding_dedup.
ORACLE_SQL = """
with recursive finite as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), usable as (select *, sqrt(list_dot_product(e, e)) as size from finite where list_dot_product(e, e) > 0
), links as (
  select x.vec_id as a, y.vec_id as b from usable x join usable y on x.label = y.label and x.vec_id < y.vec_id and len(x.e) = len(y.e)
  where list_dot_product(x.e, y.e) / (x.size * y.size) >= 0.98
), edges as (select a, b from links union all select b, a from links
), reach(id, root) as (select vec_id, vec_id from embeddings union select e.b, r.root from reach r join edges e on e.a = r.id
), least_root as (select id, min(root) as component_id from reach group by 1
), degrees as (select a, count(*) as n from edges group by 1)
select v.vec_id, cast(coalesce(n, 0) as bigint) as n_links, component_id, v.vec_id = component_id as kept
from embeddings v join least_root on id = v.vec_id left join degrees on a = v.vec_id
"""
