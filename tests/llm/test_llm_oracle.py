"""Queries of the subpackage against their SQL, and their columns."""

import os

import duckdb
import pytest

from plainweave.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def values(rows, columns, names):
    at = [columns.index(c) for c in names]
    return sorted([tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in at) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = QUERIES[name](spark, DATA)
    got = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in got.description]
    names = sorted(columns)
    assert sorted(df.columns) == names
    assert values([tuple(r) for r in df.collect()], df.columns, names) == values(got.fetchall(), columns, names)


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [*[f"op{k}" for k in range(1, 11)], "pipeline"]
