"""Closed forms: grids, kernels, schedules, slices, names, spillover, transforms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmap.functions import grid as g
from cellmap.functions.scalar import asinh, lookup
from cellmap.operators import meta, prep, stats
from cellmap.sources import naming, slicing, spill


def test_grid_and_distances():
    x = g.rectangular(4, 3)
    assert x.shape == (12, 2) and x[5].tolist() == [1.0, 1.0] and x[0].tolist() == [0.0, 0.0]
    m = g.dist_matrix()(x)
    assert (np.diag(m) == 0).all() and m[0, 11] == 3.0 and (m == m.T).all()
    a, b = np.array([[1.0, 2.0]]), np.array([[4.0, 6.0]])
    assert [g.distances(a, b, k)[0, 0] for k in ("euclidean", "sqeuclidean", "cityblock", "chebyshev")] == [5, 25, 7, 4]
    assert math.isclose(g.distances(a, b, "cosine")[0, 0], 1 - 16 / (math.sqrt(5) * math.sqrt(52)))
    assert g.distances(a, b, lambda x, y: np.array([[9.0]]))[0, 0] == 9
    with pytest.raises(ValueError):
        g.distances(a, b, "none")


def test_kernels():
    assert np.allclose(g.gaussian_kernel(np.arange(1, 8), 2.0), [0.1760326, 0.1209853, 0.0647587, 0.0269954, 0.0087641, 0.0022159, 0.0004363], atol=1e-6)
    assert np.allclose(g.bubble_kernel(np.arange(1, 7), 5.0), [0.979796, 0.916515, 0.8, 0.6, 0, 0], atol=1e-6)
    assert np.allclose(g.threshold_kernel(np.arange(1, 11), 5), [1] * 5 + [0] * 5, atol=1e-3)
    assert np.allclose(g.threshold_kernel(np.arange(1, 11), 10.1), [1] * 8 + [0] * 2, atol=1e-3)


def test_radii():
    r = [g.exp_radius(0.0)(5.0, 0.5, e, 10) for e in range(1, 11)]
    assert np.allclose(np.array(r[1:]) / np.array(r[:-1]), r[1] / r[0]) and math.isclose(r[-1], 0.5)
    r = [g.exp_radius(-10.0)(10.0, 0.1, e, 20) for e in range(1, 21)]
    assert math.isclose(r[0], 10) and math.isclose(r[-1], 0.1)
    r = [g.exp_radius(-5.0)(10.0, 0.1, e, 20) for e in range(1, 21)]
    want = [10, 8.032403, 6.4496, 5.176339, 4.152085, 3.32814, 2.66533, 2.132143, 1.703229, 1.358196, 1.08064, 0.857364, 0.677754, 0.533269, 0.41704, 0.323542, 0.248329, 0.187825, 0.139153, 0.1]
    assert np.allclose(r, want, atol=1e-5)
    r = [g.linear_radius(50.0, 0.001, e, 30) for e in range(1, 31)]
    assert np.allclose(np.diff(r), r[1] - r[0]) and r[0] == 50 and r[-1] == 0.001
    assert g.exp_radius(-5.0)(10.0, 0.1, 1, 1) == pytest.approx(10)
    with pytest.raises(ValueError):
        g.exp_radius(-101.0)(10.0, 0.1, 1, 10)
    with pytest.raises(ValueError):
        g.exp_radius()(0.0, 0.1, 1, 10)


def test_slices():
    s = slicing.slices_of
    assert s([11], 2) == [(1, 1, 1, 6), (1, 7, 1, 11)]
    assert s([30, 40, 50], 1) == [(1, 1, 3, 50)]
    assert s([30, 40, 50], 2) == [(1, 1, 2, 30), (2, 31, 3, 50)]
    assert s([30, 40, 50], 3) == [(1, 1, 2, 10), (2, 11, 3, 10), (3, 11, 3, 50)]
    assert s([30, 40, 50], 4) == [(1, 1, 1, 30), (2, 1, 2, 30), (2, 31, 3, 20), (3, 21, 3, 50)]
    assert s([30, 40, 50], 5) == [(1, 1, 1, 24), (1, 25, 2, 18), (2, 19, 3, 2), (3, 3, 3, 26), (3, 27, 3, 50)]
    files = [np.full(4, 1), np.full(4, 2)]
    load = lambda f, first, n: files[f - 1][first : first + n]
    assert [slicing.collect_slice(load, x, [4, 4]).tolist() for x in s([4, 4], 3)] == [[1, 1, 1], [1, 2, 2], [2, 2]]
    for lengths in ([], [0, 3, 0, 5], [1], [2, 2, 2]):
        for n in (1, 2, 3, 7):
            sizes = [sum(k for _, _, k in slicing.file_ranges(x, lengths)) for x in s(lengths, n)]
            assert sum(sizes) == sum(lengths) and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_names():
    assert naming.clean_names(["CD3-a", "3x", "CD3_a", "CD3-a", ""]) == ["CD3_a", "_3x", "CD3_a_2", "CD3_a_3", ""]
    table = naming.channel_table({"$PAR": "2", "$P1N": "A", "$P2N": "B", "$P1S": " ", "$P2S": "x ", "$PROJ": "p", "$P12N": "beyond"})
    assert table == [{"N": "A", "S": " "}, {"N": "B", "S": "x "}]
    assert naming.marker_names(table) == (["A", "B"], ["A", "x "])
    assert naming.marker_names([{"N": "A"}]) == (["A"], ["A"])


def test_spillover(spark):
    names, m = spill.parse_spillover("2,A,B,1,0.5,0.25,1")
    assert names == ["A", "B"] and m.tolist() == [[1, 0.5], [0.25, 1]]
    with pytest.raises(ValueError):
        spill.parse_spillover("2,A,B,1,0.5")
    assert spill.find_spillover({"SPILL": "1,A,1", "$SPILLOVER": "1,B,1"})[0] == ["B"] and spill.find_spillover({}) is None
    df = spill.compensate(spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double"), m, ["a", "b"])
    assert np.allclose(df.first()[:2], np.array([1.0, 2.0]) @ np.linalg.inv(m)) and df.first()["c"] == 3.0


def test_transforms(spark):
    values = [-1e9, -1e5, -100.0, -2.5, 1e-9, 0.0, 1.0, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert np.allclose([r[0] for r in df.select(asinh(F.col("v"), 1.0)).collect()], np.arcsinh(values), rtol=1e-15, atol=0)
    assert [r[0] for r in spark.range(0, 5).select(lookup(F.col("id"), [7, 8, 9])).collect()] == [None, 7, 8, 9, None]
    flat = prep.dscale(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert sorted(map(tuple, flat)) == [(-1.0, 0.0), (1.0, 0.0)]
    with pytest.raises(Exception, match="null in a"):
        prep.check_no_nulls(spark.createDataFrame([(None,)], "a double"), ["a"]).collect()


def test_stats(spark):
    rng = np.random.default_rng(1)
    x, b = rng.random((1111, 3)), rng.integers(1, 4, 1111)
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, b)], "a double, b double, c double, k int")
    means, sdevs = stats.dstat(df, ["a", "b", "c"])
    assert np.allclose(means, x.mean(axis=0)) and np.allclose(sdevs, x.std(axis=0))
    by = {r["k"]: r for r in stats.dmedian_buckets(df, "k", ["a"]).collect()}
    assert all(math.isclose(by[k]["a_median"], np.median(x[b == k, 0])) for k in (1, 2, 3))
    near = stats.dmedian(df, ["a"], approximate=True).first()[0]
    assert abs(near - np.median(x[:, 0])) < 0.01
    assert stats.dmapreduce(df, lambda it: sum(t.num_rows for t in it), lambda p, q: p + q) == 1111
    counts = {(r["k"], r["j"]): r["n"] for r in stats.dcount_buckets(df.withColumn("j", F.col("k")), "j", 4, "k", 3).collect()}
    assert len(counts) == 12 and all(counts[i, j] == (i == j) * (b == i).sum() for i, j in counts)


def test_average_linkage():
    points = np.array([[0.0], [0.1], [5.0], [5.1], [20.0]])
    assert meta.metaclusters(points, 3) == [1, 1, 2, 2, 3]
    assert meta.metaclusters(points, 1) == [1] * 5 and meta.metaclusters(points, 5) == [1, 2, 3, 4, 5]
