"""Registered queries against DuckDB on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "f1_prefilter", "f3_rejects", "k6_context",
    "j1", "r1", "r3", "r5", "r7", "r13", "r16", "g1", "n4", "n5", "n8", "n12", "n22", "n27", "x1", "x4", "x12", "x16", "x21", "x31",
    "x34", "j4", "j5", "m1", "io11", "io12", "g4", "w7", "st2", "st4", "k12_pools", "k18",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="supplied tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    order = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in order) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(canon(r[names.index(c)]) for c in order) for r in cur.fetchall())
    assert sorted(names) == order
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()) > 0)"], cwd=root, capture_output=True, text=True)
    assert done.stdout.strip() == "True", done.stderr[-2000:]


def test_entry(spark):
    df = entry.entry(spark)
    assert {"jd_id", "resume_id", "rerank_score", "analysis"} <= set(df.columns)
