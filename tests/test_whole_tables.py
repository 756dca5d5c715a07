"""Queries over files hold every row of their table."""

import numpy as np

from cellmap.plans import catalogue


def test_fcs_set_holds_every_event(spark, tmp_path):
    n = 4_321
    values = np.random.default_rng(2).lognormal(size=n)
    spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "event_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in catalogue.fcs_scan(spark, str(tmp_path)).collect())
    assert got == [(i, float(np.float32(v)), 1 if i < 700 else 2 if i < 1900 else 3) for i, v in enumerate(values)]
    assert sum(r["n"] for r in catalogue.fcs_slices(spark, str(tmp_path)).collect()) == n


def test_csv_set_holds_every_part(spark, tmp_path):
    """Keys of zero and below, very large ones and none."""
    keys = [-3, 0, 1, 50, 51, 120, 121, 10**9 + 1, None]
    spark.createDataFrame([(k, i + 0.25) for i, k in enumerate(keys)], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted((tuple(r) for r in catalogue.csv_set_scan(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == [(k if k is None else float(k), i + 0.25, 3 if k is None or k > 120 else 2 if k > 50 else 1) for i, k in enumerate(keys)]
