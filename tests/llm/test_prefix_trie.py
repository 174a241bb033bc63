"""The trie against one built in plain Python, with tiny blocks so that every level is used."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from docgauge.llm import prefix_trie as trie

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """All nodes by dictionaries of whole prefixes."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + ts[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    kids, leaves, saved = {}, {}, {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(cs) - 1) * len(p[-1][1].encode()) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if built[c] == p).encode()).hexdigest()
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids.get(p, 0), leaves[p], saved[p], ends(p)) for p, cs in members.items())


def run(df):
    return sorted(tuple(r) for r in trie.prefix_trie(df).collect())


@pytest.mark.parametrize(("block", "seed"), [(2, 1), (3, 2), (1024, 3)])
def test_against_plain_trie(spark, monkeypatch, block, seed):
    monkeypatch.setattr(trie, "BLOCK", block)
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot"]), "é" * rng.randint(0, 2)) for c in rng.sample(range(-20, 90), 60) for t in range(rng.choice([0, 1, 2, 3, 12]))]
    rows += [(200 + i, t, "user", "same") for i in range(25) for t in range(10)]  # many copies
    rows += [(300 + i, t, "user", "down") for i in range(12) for t in range(12 - i)]  # each a prefix of the one before
    rows += [(400, t, "user", str(t % 3)) for t in range(40)]  # one long conversation
    rng.shuffle(rows)
    assert run(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_edges(spark, monkeypatch):
    rows = [(1, None, None, None), (1, None, None, None), (1, 0, "user", ""), (2, 0, None, "a"), (2, 0, "user", "a"), (2, 0, "user", "A"), (None, 1, "user", "lost"), (7, 5, "x", "y"), (3, 1, "u", "w" * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("conv", "rank", "block", "items", "size", "token", "pos", "at", "part")})
    assert run(df) == plain(rows)
    assert run(df.where("conv_id = 7")) == plain([r for r in rows if r[0] == 7])
    assert trie.prefix_trie(df.limit(0)).count() == 0
    assert trie.prefix_trie(df.where("conv_id is null")).count() == 0


def test_numbering_of_groups_over_partitions(spark):
    rng = random.Random(4)
    rows = [("a" if i < 300 else rng.choice("bcdef"), i, rng.randint(0, 5)) for i in range(500)]
    out = trie.numbered(spark.createDataFrame(rows, "k string, i long, w long"), "k", [F.col("i")], lambda t: trie.stored(t), (), ("w",)).collect()
    order = sorted(rows)
    names, sums = sorted({r[0] for r in rows}), np.cumsum([0] + [r[2] for r in order])
    first = {k: next(i for i, r in enumerate(order) if r[0] == k) for k in names}
    want = {(k, i): (n, names.index(k), first[k], sums[first[k]], sums[n + 1]) for n, (k, i, _) in enumerate(order)}
    assert {(r.k, r.i): (r.nth, r.group, r.start, r.before_w, r.upto_w) for r in out} == want


def test_block_searches():
    rng = np.random.default_rng(6)
    value = rng.integers(0, 5, 40)
    frame = pd.DataFrame({"block": 0, "pos": np.arange(100, 140), "value": value})
    got = trie.smaller_in_block(frame.sample(frac=1, random_state=1))
    for r in got.itertuples():
        i = r.pos - 100
        left, right = [k for k in range(i) if value[k] < value[i]], [k for k in range(i + 1, 40) if value[k] < value[i]]
        assert (r.lo, r.hi) == (100 + left[-1] if left else -1, 100 + right[0] if right else -1)
    asked = pd.DataFrame([(0, a, b) for a in range(100, 140, 3) for b in range(a, 140, 5)], columns=["block", "a", "b"])
    assert all(r.least == value[r.a - 100 : r.b - 99].min() for r in trie.least(asked, frame).itertuples())


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.execute(trie.ORACLE_SQL)
    names = [d[0] for d in want.description]
    df = trie.op13_prefix_trie(spark, SF)
    assert df.columns == names
    key = lambda r: (r[1], r[0], r[7])
    assert sorted((tuple(r) for r in df.collect()), key=key) == sorted(want.fetchall(), key=key)
