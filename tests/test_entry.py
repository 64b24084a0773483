from __future__ import annotations

import pytest

import __spark_entry__
from loamdex.plans.oracles import ORACLES
from loamdex.plans.queries import QUERIES


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flagship(spark, tiny):
    assert set(__spark_entry__.entry(spark).columns) == {"query_id", "doc_id", "score", "rank"}


@pytest.fixture(scope="module")
def duck(tiny):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    import os

    for name in os.listdir(tiny):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{tiny}/{name}')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda x: format(x, ".9g") if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_and_oracle_agree(spark, tiny, duck, name):
    df = QUERIES[name](spark, tiny)
    rows = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        got = duck.execute(ORACLES[name])
        assert plain(rows, df.columns) == plain(got.fetchall(), [c[0] for c in got.description])
