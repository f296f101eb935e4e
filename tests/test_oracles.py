"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import math
from collections import Counter

import duckdb
import pytest

from agrolens.plans.registry import load_all
from agrolens.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
REG = load_all()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n, q in REG.items() if q.sql))
def test_matches_oracle(spark, con, name):
    q = REG[name]
    df = q.build(spark, SF)
    scols = df.columns
    srows = df.collect()
    res = con.execute(q.sql)
    dcols = [c[0] for c in res.description]
    drows = res.fetchall()
    assert sorted(scols) == sorted(dcols)
    so = sorted(range(len(scols)), key=lambda i: scols[i])
    do = sorted(range(len(dcols)), key=lambda i: dcols[i])
    a = Counter(tuple(_norm(r[i]) for i in so) for r in srows)
    b = Counter(tuple(_norm(r[i]) for i in do) for r in drows)
    assert a == b
