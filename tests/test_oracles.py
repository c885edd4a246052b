"""Every query against its SQL in DuckDB, over the same tables."""

import os

import duckdb
import pytest

import __spark_entry__
from lexgrid.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(r[i] for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_oracle(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, SF)
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a, b = plain([tuple(r) for r in got.collect()], got.columns), plain(want.fetchall(), names)
    assert len(a) == len(b) and len(a) > 0
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) < 2e-6) for p, q in zip(x, y, strict=True))]
    assert not wrong, wrong[:5]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
