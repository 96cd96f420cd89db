"""Every registered query against its SQL on the smallest scale."""

import duckdb
import pytest

from __spark_entry__ import TABLES, entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    frame = queries()[name](spark, FOLDER)
    got = canonical(frame.collect(), frame.columns)
    sql = oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    answer = con.execute(sql)
    titles = [d[0] for d in answer.description]
    assert sorted(titles) == sorted(frame.columns)
    assert got == canonical(answer.fetchall(), titles)


def test_entry(spark):
    assert entry(spark).count() > 0
