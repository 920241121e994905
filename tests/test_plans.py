"""Every registered plan against the checking SQL, over the smallest tables."""

import os

import duckdb
import pytest

from factflow.plans import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted(tuple(repr(round(r[k], 9)) if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = plain([tuple(r) for r in df.collect()], df.columns)
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        assert got == plain(cur.fetchall(), [d[0] for d in cur.description])
    else:
        assert got[1]


def test_entry_imports_without_the_training_operators(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
