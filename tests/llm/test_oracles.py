"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from lexgrid.llm import entries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(entries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entries.QUERIES[name](spark, SF)
    want = con.execute(entries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted((tuple(r[n] for n in names) for r in got.collect()), key=repr)
    assert rows == sorted(want.fetchall(), key=repr)
