"""Each query against its SQL on the smallest tables."""

import os
from collections import Counter

import pytest

from skimmer.plans.oracles import ORACLES
from skimmer.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(cols, found):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    duck.execute(f"CREATE OR REPLACE VIEW wanted AS {ORACLES[name]}")  # a statement that can't be a view can't be checked
    want = duck.execute("FROM wanted")
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(cols, want.fetchall())


def test_all_queries_are_named_alike():
    assert set(ORACLES) <= set(QUERIES) and all(n.startswith("q_") for n in QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    if os.path.isdir(DATA):
        assert __spark_entry__.entry(spark).count() > 0
