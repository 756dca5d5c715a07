"""Exact medians of large groups: the same as in one buffer, with few rows for each task."""

import math

import numpy as np
import pytest

from cellmap.operators import stats

SPREAD = np.random.default_rng(5)
COLUMNS = {
    "plain": SPREAD.lognormal(10, 1, 4001),
    "even": SPREAD.normal(size=4000),
    "ties": SPREAD.integers(0, 7, 4000) / 100,
    "one": np.full(300, -2.5),
    "zeros": np.array([0.0, -0.0] * 200),
    "wide": SPREAD.choice([-1.0, 1.0], 3000) * 10.0 ** SPREAD.uniform(-320, 308, 3000),
    "close": 1.0 + np.arange(1000) * 2.0**-52,
    "tiny": np.arange(-500, 500) * 5e-324,
    "huge": np.array([-1.7e308, 1.7e308] * 300 + [3.0]),
    "outlier": np.append(SPREAD.random(999), [1e300, -1e300]),
    "apart": np.array([1.0] * 500 + [9.0] * 500),
    "nan": np.array([1.0, math.nan, math.nan] * 200),
    "infinite": np.array([-math.inf, math.inf] * 200),
    "tail": np.array([-math.inf, math.inf, math.nan] * 100 + list(range(400))),
    "small": np.array([4.0, 1.0, 3.0]),
    "none": np.zeros(0),
}


@pytest.fixture
def few(monkeypatch):
    monkeypatch.setattr(stats, "FEW", 16)
    monkeypatch.setattr(stats, "BINS", 256)


def same(a, b):
    return a == b or (a is not None and b is not None and math.isnan(a) and math.isnan(b))


def test_columns(spark, few):
    """Spark's own median of each column, and of each again within buckets, of which one is null."""
    n = max(map(len, COLUMNS.values()))
    rows = [tuple(float(v[i]) if i < len(v) else None for v in COLUMNS.values()) for i in range(n)]
    df = spark.createDataFrame([(*r, None if i % 5 == 0 else "rest" if i % 997 == 1 else "b") for i, r in enumerate(rows)], ", ".join(f"{c} double" for c in COLUMNS) + ", g string").repartition(3).persist()
    names = list(COLUMNS)
    got, want = stats.dmedian(df, names).collect(), df.agg(*stats.medians(names)).collect()
    assert len(got) == 1 and all(same(got[0][f"{c}_median"], want[0][f"{c}_median"]) for c in names), (got, want)
    got, want = ({r["g"]: r for r in d.collect()} for d in (stats.dmedian_buckets(df, "g", names), df.groupBy("g").agg(*stats.medians(names))))
    assert set(got) == set(want) == {None, "rest", "b"}
    assert all(same(got[k][f"{c}_median"], want[k][f"{c}_median"]) for k in want for c in names), (got, want)
    assert stats.dmedian_buckets(df, "g", names).schema.simpleString() == df.groupBy("g").agg(*stats.medians(names)).schema.simpleString()
    df.unpersist()


def test_no_buffer_of_all_values(spark, monkeypatch):
    """A task of 300,000 distinct values in 12 parts gets bins of the parts: megabytes when their values were in one buffer."""
    monkeypatch.setattr(stats, "BINS", 256, raising=False)
    monkeypatch.setattr(stats, "FEW", 1000, raising=False)
    sc = spark.sparkContext
    df = spark.range(0, 300_000, 1, 12).selectExpr("cast(id * 7919 % 300007 as double) AS v", "id % 2 AS k").persist()
    df.count()
    values = np.arange(300_000) * 7919 % 300_007
    before = {s.stageId() for s in _stages(sc)}
    assert stats.dmedian(df, ["v"]).first()[0] == np.median(values)
    assert {r["k"]: r["v_median"] for r in stats.dmedian_buckets(df, "k", ["v"]).collect()} == {k: np.median(values[k::2]) for k in (0, 1)}
    new = [s for s in _stages(sc) if s.stageId() not in before]
    assert new and max(s.shuffleReadBytes() for s in new) < 500_000
    df.unpersist()


def _stages(sc):
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return [found.apply(i) for i in range(found.size())]
