"""Every query that has SQL gives the rows of that SQL on the smallest tables."""

import duckdb
import pytest
from paths import SMALL

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Checked in tests/llm where they are there.
OWN = [n for n in entry.oracle_sql() if not n.startswith("op")]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def normal(v):
    return round(v, 8) + 0.0 if isinstance(v, float) else [normal(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", OWN)
def test_query_matches_its_sql(spark, sql, name):
    df = entry.queries()[name](spark, SMALL)
    want = sql.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(str([normal(r[c]) for c in columns]) for r in df.collect())
    place = [want.columns.index(c) for c in columns]
    assert got == sorted(str([normal(r[i]) for i in place]) for r in want.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "rank", "doc_id", "label", "score"] and df.count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
