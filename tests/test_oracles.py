"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

from vicinage.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.sql(ORACLE_SQL[name]).fetchdf()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert text(got).equals(text(want))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
