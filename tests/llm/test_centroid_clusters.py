"""Clusters against plain integer k-means, on ties, repeated rows and refused vectors."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docgauge.llm import centroid_clusters
from docgauge.llm.centroid_clusters import integer_clusters

SF = "/root/testdata/sf0.001"


def plain(rows, k, rounds, dims):
    """(cluster, distance) per row by full scans over Python integers."""
    q = [[int(np.floor(64 * float(np.float32(x)))) for x in v] for _, v in rows]
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), q[i]))
    cs = [list(q[i]) for i in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min(range(len(cs)), key=lambda j: (dist(v, cs[j]), j))
    for _ in range(rounds):
        own = [nearest(v) for v in q]
        for j in range(len(cs)):
            mine = [v for v, o in zip(q, own, strict=True) if o == j]
            if mine:
                cs[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    own = [nearest(v) for v in q]
    return [(o, dist(v, cs[o])) for v, o in zip(q, own, strict=True)], cs


@pytest.mark.parametrize(("dims", "k", "rounds", "spread"), [(2, 4, 5, 0.05), (3, 5, 3, 4.0), (8, 3, 6, 1.0)])
def test_against_plain_kmeans(spark, dims, k, rounds, spread):
    rng = np.random.default_rng(dims)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, spread, dims) + 3 * (i % 4)]) for i in range(400)]
    rows += rows[:20]  # repeated rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.cluster, r.distance) for r in integer_clusters(df, k=k, dims=dims, rounds=rounds).collect())
    want, _ = plain(rows, k, rounds, dims)
    assert got == sorted((i, *w) for (i, _), w in zip(rows, want, strict=True))


def test_bounds_skip_scans(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 4) + 5 * (i % 8)]) for i in range(2000)]
    out = integer_clusters(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=8, dims=4, rounds=6)
    assert out.agg(F.sum("scans")).first()[0] < 0.6 * 7 * len(rows)
    assert out.agg(F.min("scans")).first()[0] == 1


def test_ties_and_refused_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [1.0]), (6, [None, 1.0]), (7, [nan, 0.0]), (8, [inf, 0.0]), (9, [3e30, 0.0]), (None, [-0.01, 0.5]), (10, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("clash") for c in ("id", "q", "v", "near", "upper", "cluster", "n")})
    out = {r.vec_id: r for r in integer_clusters(df, k=3, dims=2).collect()}
    assert set(out) == {1, 2, 10, None}  # null ids are the last to become centroids
    # all go to centroid 0 first, which the vector without id then pulls away; of the two left at zero 1 is the smaller
    assert {out[i].cluster for i in (1, 2, 10)} == {1} and out[1].distance == out[2].distance
    assert sum({r.cluster: r.cluster_inertia for r in out.values()}.values()) == out[1].inertia == sum(r.distance for r in out.values())
    assert integer_clusters(df.limit(0), k=3, dims=2).count() == 0
    assert integer_clusters(df.where("vec_id = 1"), dims=2).first().cluster == 0  # fewer vectors than centroids


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = con.execute(centroid_clusters.ORACLE_SQL)
    names = [d[0] for d in want.description]
    df = centroid_clusters.op11_centroid_clusters(spark, SF)
    assert df.columns == names
    assert sorted(tuple(r) for r in df.collect()) == sorted(want.fetchall())
