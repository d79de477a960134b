import duckdb
import pytest

import __spark_entry__
from tallyforge.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in tables.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in __spark_entry__.oracle_sql() if not n.startswith("op")))
def test_equals_sql(spark, oracle, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    expected = sorted(map(repr, oracle.sql(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]}) q").fetchall()))
    assert got == expected
