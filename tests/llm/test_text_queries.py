"""Every text query with SQL against DuckDB on whole tables."""

import duckdb
import pytest

from lexflow.llm.queries import QUERIES, SQL

ROOT = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pack_capacities"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{t}.parquet'")
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    df = QUERIES[name](spark, ROOT)
    assert df.columns == columns
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(map(repr, cursor.fetchall()))
