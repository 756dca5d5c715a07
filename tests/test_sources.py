"""FCS and CSV files, and a map on a stream."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellmap.operators import som, stats
from cellmap.sources import fcs, tables
from cellmap.sources.fcs_files import write_fcs
from cellmap.streaming.mapping import cluster_counts, map_stream


@pytest.fixture
def files(tmp_path):
    rng = np.random.default_rng(5)
    out = []
    for i, n in enumerate((30, 0, 40, 51)):
        x = rng.random((n, 3)).astype(np.float32)
        path = str(tmp_path / f"f{i}.fcs")
        write_fcs(path, x, ["FL1-A", "FL2-A", "Time"], ["CD3-x", " ", None], big_endian=i == 2)
        out.append((path, x))
    return out


def test_fcs(spark, files):
    paths = [p for p, _ in files]
    assert fcs.fcs_sizes(paths) == [30, 0, 40, 51]
    df = fcs.read_fcs(spark, paths, slices=4)
    assert df.columns == ["CD3_x", "FL2_A", "Time", "file_idx"]
    assert sorted(r["n"] for r in stats.part_sizes(df).collect()) == [30, 30, 30, 31]
    rows = df.collect()
    want = np.concatenate([x for _, x in files]).astype(float)
    assert np.array_equal(np.array([r[:3] for r in rows]), want)
    assert [r["file_idx"] for r in rows] == [1] * 30 + [3] * 40 + [4] * 51
    some = fcs.read_fcs(spark, paths, columns=["Time", "CD3_x"], slices=7)
    assert some.columns == ["Time", "CD3_x", "file_idx"] and some.count() == 121
    assert fcs.select_fcs_columns(["FL2_A"])(df).columns == ["FL2_A", "file_idx"]
    with pytest.raises(ValueError):
        fcs.select_fcs_columns(["none"])(df)
    keywords, x = fcs.load_fcs(paths[2])
    assert keywords["$TOT"] == "40" and np.array_equal(x, files[2][1].astype(float))
    assert [r["file_idx"] for r in fcs.file_vector(spark, [2, 0, 3], 2).orderBy("row").collect()] == [1, 1, 3, 3, 3]


def test_fcs_compensation(spark, tmp_path):
    x = np.array([[1, 2, 3], [4, 5, 6]], np.float32)
    path = str(tmp_path / "c.fcs")
    write_fcs(path, x, ["A", "B", "C"], extra={"$SPILLOVER": "2,A,C,1,0.5,0.25,1"})
    got = np.array([r[:3] for r in fcs.read_fcs(spark, path).collect()])
    want = x.astype(float)
    want[:, [0, 2]] = want[:, [0, 2]] @ np.linalg.inv([[1, 0.5], [0.25, 1]])
    assert np.allclose(got, want)
    assert np.array_equal(fcs.load_fcs(path, apply_compensation=False)[1], x.astype(float))
    write_fcs(path, x, ["A", "B", "C"], extra={"SPILL": "1,Z,1"})
    with pytest.raises(ValueError, match="unknown channels"):
        fcs.load_fcs(path)


def test_fcs_headers(tmp_path):
    path = str(tmp_path / "h.fcs")
    x = np.ones((2, 1), np.float32)
    write_fcs(path, x, ["A/B"], shift_header=3)
    with pytest.warns(UserWarning):
        assert fcs.fcs_size(*fcs.read_header(path)) == (2, 1)
    assert fcs.read_header(path)[1]["$P1N"] == "A/B"
    write_fcs(path, x, ["A"], extra={"$DATATYPE": "I"})
    with pytest.raises(ValueError):
        fcs.fcs_size(*fcs.read_header(path))
    write_fcs(path, x, ["A"])
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        fcs.fcs_size(*fcs.read_header(path))
    open(path, "wb").write(b"nothing")
    with pytest.raises(ValueError):
        fcs.read_header(path)


def test_csv(spark, tmp_path):
    paths = []
    for i, n in enumerate((3, 0, 2)):
        paths.append(str(tmp_path / f"{i}.csv"))
        open(paths[-1], "w").write("a,b\n" + "".join(f"{i},{k}.5\n" for k in range(n)))
    assert tables.csv_size(spark, paths[0]) == (3, 2) and tables.csv_sizes(spark, paths) == [3, 0, 2]
    rows = tables.read_csv_set(spark, paths, file_idx=True).orderBy("file_idx", "x2").collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.5, 1), (0.0, 1.5, 1), (0.0, 2.5, 1), (2.0, 0.5, 3), (2.0, 1.5, 3)]
    open(paths[0], "w").write("a,b\n1,x\n")
    with pytest.raises(Exception):
        tables.read_csv_set(spark, paths[:1]).collect()


def test_store(spark, tmp_path):
    df = tables.scatter(spark, __import__("pandas").DataFrame({"a": [1.0, 2.0]}), 2)
    tables.store(df, str(tmp_path / "s"))
    assert sorted(tables.gather_rows(tables.restore(spark, str(tmp_path / "s")), free=True)["a"]) == [1.0, 2.0]


def test_stream(spark, tmp_path):
    m = som.Som(np.array([[0.0], [10.0]]), 2, 1, np.array([[0.0, 0.0], [1.0, 0.0]]), ("v",))
    rows = spark.createDataFrame([(1.0, 0), (9.0, 60), (11.0, 700), (0.0, 800)], "v double, s long").select("v", F.timestamp_seconds("s").alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    counts = cluster_counts(map_stream(m, stream), "at")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    found = {(int(r["window_start"].timestamp()), r["index"]): r["n"] for r in spark.table("counts").collect()}
    assert found == {(0, 1): 1, (0, 2): 1, (600, 2): 1, (600, 1): 1}
