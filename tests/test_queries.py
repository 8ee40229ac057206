"""Every query with SQL gives the rows of that SQL; the others run and give rows."""

import math

import duckdb
import pytest

import __spark_entry__
from postmill.plans import classifier, history, judged, relational, reports, stored, streams, texts, upkeep

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = relational.QUERIES | reports.QUERIES | texts.QUERIES | upkeep.QUERIES | judged.QUERIES | classifier.QUERIES | stored.QUERIES | history.QUERIES | streams.QUERIES
SQL = relational.SQL | reports.SQL | texts.SQL | upkeep.SQL | judged.SQL | classifier.SQL | stored.SQL | history.SQL | streams.SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert columns == sorted(names)
    want = sorted([plain(r[names.index(c)]) for c in columns] for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and sum(r.n for r in rows) == 1500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
