import os

import duckdb
import pytest

import __spark_entry__ as entry
from runmill import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.sql(core.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(str, con.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({core.oracle_sql()[name]})").fetchall()))


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["pos", "o_custkey", "o_orderkey"] and df.count() == 1500


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
