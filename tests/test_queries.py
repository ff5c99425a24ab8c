"""Every query with an oracle gives the oracle's rows on the smallest tables."""

import duckdb
import pytest

import ontoscore.plans.more_queries  # noqa: F401
import ontoscore.plans.operator_queries  # noqa: F401
from ontoscore.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "NULL"
    return repr(v) if isinstance(v, float) else str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    cols = sorted(names)
    want = sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())
    got = sorted(tuple(plain(x[c]) for c in cols) for x in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
