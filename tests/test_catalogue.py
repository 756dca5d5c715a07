"""Every query of the catalogue against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from cellmap.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def norm(rows, digits=3):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, digits) + 0.0
        return v

    return sorted((tuple(value(v) for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in catalogue.queries()])
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = [tuple(r[c] for c in names) for r in df.collect()]
    assert got
    if sql := catalogue.oracle_sql().get(name):
        found = duck.execute(sql)
        columns = [x[0] for x in found.description]
        assert sorted(columns) == names
        place = [columns.index(c) for c in names]
        want = [tuple(r[i] for i in place) for r in found.fetchall()]
        a, b = norm(got), norm(want)
        assert len(a) == len(b)
        for x, y in zip(a, b):
            assert all(p == q or (isinstance(p, float) and abs(p - q) <= 2e-3 * max(1, abs(q))) for p, q in zip(x, y)), (x, y)
