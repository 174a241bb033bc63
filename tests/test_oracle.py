"""Every query with SQL gives the same rows on Spark and on DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from docgauge.plans import catalog, evidence_queries, keeping_queries, reading_queries, report_queries, rule_queries, rules, upload_queries  # noqa: F401 - registers queries

SF = "/root/testdata/sf0.001"


def value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(value(r[i]) for i in order) for r in records], key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    want = rows(names, res.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert got == want


def test_every_rule_has_a_query_with_sql():
    named = {i for family in rule_queries.FAMILIES.values() for i in family}
    assert named == set(rules.REGISTRY) and len(rule_queries.CROSS) == 9
