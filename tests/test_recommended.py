"""Ranking people for items equals the ranking over all pairs, and has no limit on the people."""

import pytest
from pyspark.sql import functions as F

from docgauge.operators import relational as R


@pytest.mark.parametrize("n", [1, 3, 7])
def test_ranks_equal_those_over_all_pairs(spark, n):
    items = [(i, i % 6 if i % 5 else None) for i in range(20)]
    people = [(p, p % 4 if p % 3 else None, p * 7 % 5) for p in range(12)]
    want = set()
    for i, kind in items:
        same = lambda p, kind=kind: None if kind is None or p[1] is None else p[1] == kind
        ranked = sorted(people, key=lambda p: ({True: 0, False: 1, None: 2}[same(p)], -p[2], p[0]))
        want |= {(i, p[0], same(p), r + 1) for r, p in enumerate(ranked[:n])}
    frames = spark.createDataFrame(items, "item long, kind long"), spark.createDataFrame(people, "person_id long, own long, score long")
    out = R.recommended(*frames, "item", "kind", "own", [F.desc("score"), F.asc("person_id")], n)
    assert {(r.item, r.person_id, r.same, r.rank) for r in out.collect()} == want and out.count() == len(want)


def test_many_people_have_ranks(spark):
    people = spark.range(25_000).selectExpr("id as person_id", "id % 3 as own", "id as score")
    items = spark.createDataFrame([(1, 0), (2, 9)], "item long, kind long")
    out = R.recommended(items, people, "item", "kind", "own", [F.desc("score")], 2).collect()
    assert {(r.item, r.person_id) for r in out} == {(1, 24999), (1, 24996), (2, 24999), (2, 24998)}
