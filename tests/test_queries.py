"""Every registered query with SQL gives DuckDB's rows on the smallest tables; all have stable columns."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
CHECKED = [n for n in QUERIES if n in ORACLES]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables aren't here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    return f"{float(v) + 0.0:.6g}" if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    order = sorted(got.columns)
    assert order == sorted(names)
    place = [names.index(c) for c in order]
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in place) for r in want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
