"""Every query with SQL against that SQL on the smallest tables."""

import math

import duckdb
import pytest

from casebook.queries import ORACLES, QUERIES, load_all

ROOT = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
load_all()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{ROOT}/{t}.parquet')")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, ROOT)
    cols = sorted(df.columns)
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    key = lambda row: tuple((v is None, round(v, 4) if isinstance(v, float) else v) for v in row)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=lambda r: str(key(r)))
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=lambda r: str(key(r)))
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_no_query_is_missing():
    assert len(QUERIES) >= 100 and set(ORACLES) <= set(QUERIES)
