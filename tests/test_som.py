"""Training, mapping and projection against plain numpy."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmap.functions import grid as g
from cellmap.operators import embed, som


@pytest.fixture(scope="module")
def cells():
    rng = np.random.default_rng(3)
    return (rng.integers(0, 2, (600, 4)) * 10 + rng.normal(size=(600, 4))).astype(float)


@pytest.fixture(scope="module")
def data(spark, cells):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(cells)], "id long, a double, b double, c double, d double").repartition(3).persist()


COLS = ["a", "b", "c", "d"]


def plain_train(x, m, epochs, radius):
    codes, dist = m.codes.copy(), g.dist_matrix()(m.grid)
    for e in range(1, epochs + 1):
        near = np.argmin(((x[:, None] - codes[None]) ** 2).sum(axis=2), axis=1)
        w = g.gaussian_kernel(dist, radius((m.xdim + m.ydim) / 2, 0.1, e, epochs))
        n = np.bincount(near, minlength=len(codes))
        sums = np.stack([np.bincount(near, x[:, j], len(codes)) for j in range(x.shape[1])], axis=1)
        codes = (w @ sums) / (w @ n)[:, None]
    return codes


def test_init(data, cells):
    a = som.init_som(data, COLS, 5, 4, seed=9)
    b = som.init_som_from_stats(cells.mean(axis=0), cells.std(axis=0), 5, 4, seed=9)
    assert np.allclose(a.codes, b.codes) and a.n_codes == 20 and a.grid.shape == (20, 2)


def test_train_map(data, cells):
    m = som.init_som(data, COLS, 5, seed=1)
    calls = []
    t = som.train_som(m, data, epochs=5, each_epoch=lambda e, r, s: calls.append((e, r)))
    assert np.allclose(t.codes, plain_train(cells, m, 5, g.exp_radius(-5.0)))
    assert [e for e, _ in calls] == [0, 1, 2, 3, 4, 5] and calls[0][1] == 5.0
    rows = som.map_to_som(t, data, keep=["id"]).orderBy("id").collect()
    want = np.argmin(g.distances(cells, t.codes), axis=1) + 1
    assert [r["index"] for r in rows] == want.tolist()
    assert [r["index"] for r in som.map_to_som_sql(t, data).orderBy("id").collect()] == want.tolist()
    near = som.knn(t, data, 3, keep=["id"]).filter("rank = 1").orderBy("id").collect()
    assert [r["unit"] for r in near] == want.tolist()


def test_empty_units(data):
    m = som.init_som(data, COLS, 6, seed=2)
    small = data.limit(5)
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        kept = som.train_som(m, small, kernel=g.bubble_kernel, r_start=1.0, r_final=1.0, radius=g.linear_radius, epochs=1)
        assert any("units" in str(x.message) for x in w) and not np.isnan(kept.codes).any()
    lost = som.train_som(m, small, kernel=g.bubble_kernel, r_start=1.0, r_final=1.0, radius=g.linear_radius, epochs=1, on_empty="nan")
    assert np.isnan(lost.codes).any()


def test_dimensions_and_nulls(spark, data):
    m = som.init_som(data, COLS, 3, seed=1)
    with pytest.raises(ValueError):
        som.map_to_som(m, data, ["a", "b"])
    with pytest.raises(ValueError):
        embed.embed_som(m, data, ["a"])
    with pytest.raises(Exception, match="null in"):
        som.map_to_som(m, data.withColumn("a", F.lit(None).cast("double"))).collect()
    assert som.map_to_som(m, data.limit(0)).count() == 0


def slow_embed(x, m, k, adjust, boost, mm, product=True):
    """One row at a time, in the textbook form."""
    out = []
    for row in x:
        dist = np.sqrt(((m.codes - row) ** 2).sum(axis=1))
        nk = min(k + 1, len(dist))
        ids = np.argsort(dist, kind="stable")[:nk]
        d = dist[ids]
        w = 1 / np.arange(1, nk + 1)
        mean = np.average(d, weights=w)
        sd = boost / math.sqrt(np.average(d * d, weights=w) - mean**2)
        s = np.exp((mean - d[:k]) * sd)
        if k < nk:
            s *= 1 - np.exp(d[:k] * mm / d[-1] - mm)
        a, rhs = np.zeros((2, 2)), np.zeros(2)
        for i in range(k):
            gi = m.grid[ids[i]]
            a += 1e-9 * s[i] * np.eye(2)
            rhs += 1e-9 * s[i] * gi
            for j in range(i + 1, k):
                ci, cj = m.codes[ids[i]], m.codes[ids[j]]
                t = ci * cj if product else cj - ci
                p, q = t @ (row - ci), t @ t
                if p != 0:
                    if q == 0:
                        continue
                    p /= q
                h = m.grid[ids[j]] - gi
                hp = h @ h
                wt = s[i] * s[j] * (1 + hp) ** -adjust * math.exp(-((p - 0.5) ** 2))
                a += np.outer(h, h) * wt / hp
                rhs += h * wt * (p + h @ gi / hp)
        out.append(np.linalg.solve(a, rhs))
    return np.array(out)


@pytest.mark.parametrize("edge", ["product", "difference"])
@pytest.mark.parametrize(("k", "smooth", "mm"), [(0, 0.0, 10.0), (4, 0.1, 4.5), (20, 0.0, 10.0)])
def test_embed(data, cells, edge, k, smooth, mm):
    m = som.init_som(data, COLS, 5, 4, seed=4)
    rows = embed.embed_som(m, data, keep=["id"], k=k, smooth=smooth, m=mm, adjust=1.5, edge=edge).orderBy("id").collect()
    want = slow_embed(cells, m, k or 5, 1.5, math.exp(-smooth - 1), mm, edge == "product")
    assert np.allclose([[r["x1"], r["x2"]] for r in rows], want, rtol=1e-5, atol=1e-5)


def test_save(spark, data, tmp_path):
    m = som.init_som(data, COLS, 3, 2, seed=1)
    m.save(spark, str(tmp_path / "som"))
    back = som.Som.load(spark, str(tmp_path / "som"), tuple(COLS))
    assert np.array_equal(back.codes, m.codes) and np.array_equal(back.grid, m.grid) and (back.xdim, back.ydim) == (3, 2)


def test_training_reads_once(spark, data, cells):
    """All epochs take one pass over the input; three passes before."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    t = som.train_som(som.init_som(data, COLS, 5, seed=1), data.select(*COLS).mapInArrow(count, "a double, b double, c double, d double"), epochs=3)
    assert read.value == len(cells)
    assert np.allclose(t.codes, plain_train(cells, som.init_som(data, COLS, 5, seed=1), 3, g.exp_radius(-5.0)))
    with pytest.raises(Exception, match="null in b"):
        som.train_som(t, data.withColumn("b", F.lit(None).cast("double")), epochs=2)
    none = spark.createDataFrame([], "a double, b double, c double, d double")
    with pytest.warns(UserWarning, match="no rows"):
        assert np.array_equal(som.train_som(t, none, epochs=2).codes, t.codes)


@pytest.mark.parametrize("metric", ["euclidean", "sqeuclidean"])
@pytest.mark.parametrize("kind", ["plain", "ties", "far", "near", "equal", "huge", "tiny", "odd", "lost", "many", "wide", "none"])
def test_nearest_is_least_distance(kind, metric):
    """The units of a matrix product are those of the distances, in ties and where numbers lose digits, too."""
    rng = np.random.default_rng(8)
    codes, x = rng.normal(size=(25, 4)), rng.normal(size=(5000, 4))
    if kind == "ties":
        codes, x = rng.integers(-2, 3, (25, 4)).astype(float), rng.integers(-4, 5, (5000, 4)) / 2
    elif kind == "far":
        codes, x = codes + 1e9, x + 1e9
    elif kind == "near":
        codes = 1 + rng.integers(0, 9, (25, 4)) * 2.0**-52
    elif kind == "equal":
        codes[:] = codes[0]
    elif kind == "huge":
        codes, x = codes * 1e160, x * 10.0 ** rng.integers(100, 300, (5000, 1))
    elif kind == "tiny":
        codes, x = codes * 1e-162, x * 1e-162
    elif kind == "odd":
        x[::3, 1], x[1::7, 2], x[2::7, 0] = np.nan, np.inf, -np.inf
    elif kind == "lost":
        codes[7] = np.nan
    elif kind == "many":
        codes = rng.normal(size=(300, 4))
    elif kind == "wide":
        codes, x = rng.normal(size=(40, 64)), rng.normal(size=(900, 64))
    elif kind == "none":
        x = x[:0]
    with np.errstate(all="ignore"):
        want = g.distances(x, codes, metric).argmin(axis=1)
        assert np.array_equal(som.nearest(x, codes, metric), want)
