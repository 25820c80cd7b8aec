"""Every registered query against its SQL, over the whole small tables."""

import math
import os

import duckdb
import pytest
from conftest import SMALL, entry_points

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        return None if isinstance(v, float) and math.isnan(v) else v

    return sorted(columns), sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    got = _rows(frame.columns, frame.collect())
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert got == _rows(columns, found.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["lang", "documents", "words", "avg_words"]
    assert frame.count() > 0
