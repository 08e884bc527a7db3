"""Every query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from statelace import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return abs(a - b) <= 2e-6 * max(1, abs(a)) or (a != a and b != b)
    return a == b


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:  # values are held against loops or known answers in test_semantics
        numbers = [x for r in got for x in r if isinstance(x, float)]
        assert got and all(math.isfinite(x) for x in numbers)
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    a, b = rows(df.columns, got), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if not all(map(same, x, y))]
    assert not wrong, wrong[:3]


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "transition_probability" in e.queries()
