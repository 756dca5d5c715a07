"""The query catalogue: every operator as a query over the test tables, with SQL beside it.

Accumulated numbers are rounded in both, as results are compared by value.
"""

from __future__ import annotations

import math
import os

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid as g
from ..functions.scalar import asinh
from ..operators import embed, meta, prep, som, stats
from ..sources import fcs, fcs_files, naming, slicing, spill, tables
from . import oracles, sql_functions

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
#: All elements of the embeddings.
VEC = [f"v{j}" for j in range(64)]
SPILL = np.array([[1.0, 0.1, 0.02], [0.05, 1.0, 0.03], [0.01, 0.2, 1.0]])
SPILLED = ["l_quantity", "l_discount", "l_tax"]
#: A 5 x 5 map over scaled columns that many queries share.
NOISE = np.round(np.random.default_rng(7).standard_normal((25, 4)), 6)
MAP = som.Som(NOISE, 5, 5, g.rectangular(5, 5), tuple(LINE))
VEC_MAP = som.Som(np.round(np.random.default_rng(11).standard_normal((25, len(VEC))), 6), 5, 5, g.rectangular(5, 5), tuple(VEC))
EXP5 = g.exp_radius(-5.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(e: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(e) if isinstance(e, str) else e, digits) + F.lit(0.0)


def lineitem(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(*LINE)


def scaled(spark, d) -> DataFrame:
    return prep.dscale(lineitem(spark, d), LINE)


def vectors(spark, d) -> DataFrame:
    df = table(spark, d, "embeddings")
    return df.select("vec_id", "label", *[F.get("embedding", F.lit(j)).cast("double").alias(c) for j, c in enumerate(VEC)])


VECTORS = "SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{j + 1}] AS DOUBLE) AS x{j}" for j in range(len(VEC))) + " FROM embeddings"
SCALED = oracles.z_scaled("lineitem", LINE)


# ---------------------------------------------------------------- preparation

def flagship(spark, d) -> DataFrame:
    """Arcsinh, scaling, nearest units of a fixed map, and counts and means of each cluster."""
    prepared = prep.dscale(prep.dtransform_asinh(lineitem(spark, d), ["l_quantity", "l_extendedprice"]), LINE)
    mapped = som.map_to_som(MAP, prepared, keep=LINE)
    return stats.bucket_means(mapped, "index", LINE).select("index", "n", *[rounded(f"{c}_mean", 5).alias(f"{c}_mean") for c in LINE])


ASINH_LINE = "SELECT asinh(l_quantity / 5) AS l_quantity, asinh(l_extendedprice / 5) AS l_extendedprice, l_discount, l_tax FROM lineitem"
FLAGSHIP_SQL = f"""
WITH data AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM ({oracles.z_scaled(f'({ASINH_LINE})', LINE)})),
codes AS {oracles.codebook(NOISE, MAP.grid)},
near AS (SELECT rid, (min({{'d': {oracles.gap(4)}, 'id': id}})).id AS "index" FROM data CROSS JOIN codes GROUP BY rid)
SELECT "index", count(*) AS n, {', '.join(f'round(avg(x{j}), 5) + 0.0 AS {c}_mean' for j, c in enumerate(LINE))} FROM data JOIN near USING (rid) GROUP BY "index"
"""


def select_columns(spark, d):
    return prep.dselect(table(spark, d, "lineitem"), ["l_tax", "l_quantity"])


def select_by_place(spark, d):
    return prep.dselect(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), ["key", "size", "price"], ["price", "key"])


def asinh_transform(spark, d):
    return prep.dtransform_asinh(table(spark, d, "events").select("event_id", "value"), ["value"]).select("event_id", rounded("value").alias("value"))


def asinh_sql(spark, d):
    sql_functions.register(spark)
    table(spark, d, "events").createOrReplaceTempView("cellmap_events")
    return spark.sql("SELECT event_id, round(stable_asinh(value, 1.23D), 6) + 0.0D AS value FROM cellmap_events")


def zscale(spark, d):
    return scaled(spark, d).select(*[rounded(c, 5).alias(c) for c in LINE])


def asinh_zscale(spark, d):
    df = prep.dtransform_asinh(table(spark, d, "events").select("event_id", "value"), ["value"])
    return prep.dscale(df, ["value"]).select("event_id", rounded("value", 5).alias("value"))


def apply_cols(spark, d):
    df = prep.dapply_cols(table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), lambda v, i: v * (i + 2), ["p_size", "p_retailprice"])
    return df.select("p_partkey", "p_size", rounded("p_retailprice", 3).alias("p_retailprice"))


def array_spread(spark, d):
    """Every element a column, then the first and last two an array again."""
    df = prep.gather(prep.spread(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("e")), "e", VEC), [*VEC[:2], *VEC[-2:]], "ends")
    return df.select("vec_id", *VEC[2:-2], F.aggregate("ends", F.lit(0.0), lambda a, x: a + x).alias("ends"))


def compensate_linear(spark, d):
    df = spill.compensate(table(spark, d, "lineitem").select(*SPILLED), SPILL, SPILLED)
    return df.select(*[rounded(c, 5).alias(c) for c in SPILLED])


_INVERSE = np.linalg.inv(SPILL)
COMPENSATE_SQL = "SELECT " + ", ".join(
    "round(" + " + ".join(f"{s} * {oracles.number(_INVERSE[i, j])}" for i, s in enumerate(SPILLED)) + f", 5) + 0.0 AS {c}" for j, c in enumerate(SPILLED)
) + " FROM lineitem"


# ---------------------------------------------------------------- statistics

def _round_all(df: DataFrame, digits: int, *keys: str) -> DataFrame:
    return df.select(*keys, *[rounded(c, digits).alias(c) for c in df.columns if c not in keys])


def dstat(spark, d):
    return _round_all(stats.dstat_frame(lineitem(spark, d), LINE), 4)


def dstat_buckets(spark, d):
    return _round_all(stats.dstat_buckets(table(spark, d, "lineitem"), "l_returnflag", LINE), 4, "l_returnflag")


def dmedian(spark, d):
    return _round_all(stats.dmedian(lineitem(spark, d), LINE), 6)


def dmedian_buckets(spark, d):
    return _round_all(stats.dmedian_buckets(table(spark, d, "events"), "event_type", ["value"]), 6, "event_type")


def bucket_mean(spark, d):
    return stats.bucket_means(table(spark, d, "lineitem"), "l_returnflag", LINE).select("l_returnflag", "n", *[rounded(f"{c}_mean", 4).alias(f"{c}_mean") for c in LINE])


def map_buckets(spark, d):
    return _round_all(stats.map_buckets(table(spark, d, "lineitem"), "l_linestatus", LINE[:2], lambda v: F.max(v) - F.min(v), "range"), 4, "l_linestatus")


def cat_map_buckets(spark, d):
    def spread(frame):
        return frame.groupby("event_type", as_index=False)["value"].agg(lambda v: round(float(v.max() - v.min()), 6))

    return stats.cat_map_buckets(table(spark, d, "events").select("event_type", "value"), "event_type", spread, "event_type string, value double")


def global_mean(spark, d):
    return _round_all(stats.global_means(lineitem(spark, d), LINE), 4)


def map_reduce_sum(spark, d):
    """Rows and sums by a fold over parts."""
    def part(batches):
        n, total = 0, 0.0
        for b in batches:
            n, total = n + b.num_rows, total + float(b.column("l_quantity").to_numpy().sum())
        return n, total

    n, total = stats.dmapreduce(lineitem(spark, d), part, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return spark.createDataFrame([(n, total)], "n long, total double")


def _labelled(spark, d):
    return table(spark, d, "embeddings").select((F.col("label") + 1).alias("id"), (F.pmod(F.col("vec_id"), F.lit(4)) + 1).cast("int").alias("bucket"))


def dcount(spark, d):
    return stats.dcount(_labelled(spark, d), "id", 12)


def dcount_buckets(spark, d):
    return stats.dcount_buckets(_labelled(spark, d), "id", 11, "bucket", 5)


def _files(spark, d):
    return table(spark, d, "events").groupBy("event_type").count().orderBy("event_type").collect()


def file_counts(spark, d):
    sizes = [r["count"] for r in _files(spark, d)]
    return stats.dcount(fcs.file_vector(spark, sizes, 4), "file_idx", len(sizes))


def slice_sizes(spark, d):
    sizes = [r["count"] for r in _files(spark, d)]
    rows = [(s + 1, sum(n for _, _, n in slicing.file_ranges(x, sizes))) for s, x in enumerate(slicing.slices_of(sizes, 7))]
    return spark.createDataFrame(rows, "slice int, n long")


def part_sizes(spark, d):
    """The whole table dealt over four parts by identifier."""
    return stats.part_sizes(table(spark, d, "events").select("event_id").repartitionById(4, F.pmod("event_id", F.lit(4)).cast("int"))).select("part", "n")


# ---------------------------------------------------------------- maps

def _frame(spark, x: np.ndarray, names: str) -> DataFrame:
    return spark.createDataFrame([tuple(float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names.split()))


def som_grid(spark, d):
    return spark.createDataFrame([(i + 1, float(x), float(y)) for i, (x, y) in enumerate(g.rectangular(4, 3))], "id int, gx double, gy double")


def _pairs(spark, metric):
    m = g.dist_matrix(metric)(g.rectangular(4, 3))
    return spark.createDataFrame([(i + 1, j + 1, round(float(m[i, j]), 9)) for i in range(12) for j in range(12)], "a int, b int, dist double")


def _kernel(spark, f, r):
    x = np.arange(0, 11, dtype=float)
    return _frame(spark, np.stack([x, np.round(f(x, r), 9)], axis=1), "x w")


def _radius(spark, f, a, b, n):
    return spark.createDataFrame([(e, round(f(a, b, e, n), 6)) for e in range(1, n + 1)], "epoch int, r double")


def som_init(spark, d):
    m = som.init_som(lineitem(spark, d), LINE, 5, 5, rng=_Fixed())
    return spark.createDataFrame([(i + 1, *(round(float(v), 4) + 0.0 for v in c)) for i, c in enumerate(m.codes)], "id int, c0 double, c1 double, c2 double, c3 double")


class _Fixed:
    """Draws the catalogue's fixed noise, so that SQL can state the same map."""

    def standard_normal(self, shape):
        assert shape == NOISE.shape
        return NOISE


def som_epoch_sums(spark, d):
    return _round_all(som.epoch_sums(scaled(spark, d), LINE, NOISE), 4, "id", "n")


def _codes(spark, m: som.Som, digits: int = 5) -> DataFrame:
    rows = [(i + 1, *(round(float(v), digits) + 0.0 for v in c)) for i, c in enumerate(m.codes)]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"c{j} double" for j in range(m.codes.shape[1])))


def _train(epochs, kernel=g.gaussian_kernel, radius=EXP5, r_start=0.0, r_final=0.1):
    def run(spark, d):
        return _codes(spark, som.train_som(MAP, scaled(spark, d), LINE, kernel=kernel, radius=radius, r_start=r_start, r_final=r_final, epochs=epochs))

    return run


def _train_sql(epochs, kind="gaussian", radius=EXP5, r_start=5.0, r_final=0.1):
    radii = [radius(r_start, r_final, e, epochs) for e in range(1, epochs + 1)]
    return oracles.trained(SCALED, NOISE, 5, 5, radii, kind) + "\nSELECT id, " + ", ".join(f"round(c{j}, 5) + 0.0 AS c{j}" for j in range(4)) + " FROM codes"


def _map(metric="euclidean"):
    return lambda spark, d: som.map_to_som(VEC_MAP, vectors(spark, d), keep=["vec_id"], metric=metric)


def _map_sql(metric="euclidean"):
    return f"""SELECT vec_id, (min({{'d': {oracles.gap(len(VEC), metric)}, 'id': id}})).id AS "index" FROM ({VECTORS}) CROSS JOIN {oracles.codebook(VEC_MAP.codes, VEC_MAP.grid)} GROUP BY vec_id"""


def map_by_expressions(spark, d):
    return som.map_to_som_sql(VEC_MAP, vectors(spark, d)).select("vec_id", "index")


def cluster_sizes(spark, d):
    return stats.dcount(_map()(spark, d), "index", 25)


def cluster_means(spark, d):
    mapped = som.map_to_som(MAP, scaled(spark, d), keep=LINE)
    return stats.bucket_means(mapped, "index", LINE).select("index", "n", *[rounded(f"{c}_mean", 5).alias(f"{c}_mean") for c in LINE])


CLUSTER_MEANS_SQL = FLAGSHIP_SQL.replace(oracles.z_scaled(f"({ASINH_LINE})", LINE), SCALED)


def knn_codes(spark, d):
    return som.knn(VEC_MAP, vectors(spark, d), 4, keep=["vec_id"]).select("vec_id", "rank", F.col("unit").alias("id"), rounded("distance").alias("distance"))


KNN_SQL = f"""
SELECT vec_id, CAST(r AS INTEGER) AS rank, id, round(d, 6) + 0.0 AS distance FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, id) AS r FROM (
    SELECT vec_id, id, {oracles.gap(len(VEC))} AS d FROM ({VECTORS}) CROSS JOIN {oracles.codebook(VEC_MAP.codes, VEC_MAP.grid)})) WHERE r <= 4
"""


def _embed(**options):
    def run(spark, d):
        e = embed.embed_som(VEC_MAP, vectors(spark, d), keep=["vec_id"], **options)
        return e.select("vec_id", rounded("x1", 4).alias("x1"), rounded("x2", 4).alias("x2"))

    return run


def _embed_sql(k=0, adjust=1.0, smooth=0.0, m=10.0, edge="product"):
    k = min(k or math.floor(1 + math.sqrt(25)), 25)
    return oracles.embedded(VECTORS, "vec_id", VEC_MAP.codes, 5, 5, k, adjust, math.exp(-smooth - 1), m, edge)


META = meta.metaclusters(VEC_MAP.codes, 6)


def metacluster_expand(spark, d):
    return prep.relabel(_map()(spark, d), "index", META, "metacluster")


def metacluster_assign(spark, d):
    return spark.createDataFrame([(i + 1, m) for i, m in enumerate(META)], "id int, metacluster int")


# ---------------------------------------------------------------- files

def _fcs_set(spark, d):
    """The whole table as three FCS files: the first 700 rows, the next 1200 and all others."""
    rows = table(spark, d, "events").select("event_id", "value")
    ids = [r[0] for r in rows.select("event_id").orderBy(F.asc_nulls_last("event_id")).limit(1900).collect()]
    first, second = (F.coalesce(F.col("event_id") <= F.lit(ids[min(n, len(ids)) - 1] if ids else None), F.lit(False)) for n in (700, 1900))
    folder = fcs_files.shared_folder(spark)
    paths = []
    for i, part in enumerate((first, second & ~first, ~second)):
        paths.append(os.path.join(folder, f"f{i}.fcs"))
        fcs_files.write_table(rows.filter(part), paths[-1], ["E-id", "V"], [None, "CD3-x"], big_endian=i == 1)
    return paths


def fcs_scan(spark, d):
    return fcs.read_fcs(spark, _fcs_set(spark, d), slices=5).transform(fcs.select_fcs_columns(["CD3_x", "E_id"])).select(F.col("E_id").cast("long").alias("event_id"), "CD3_x", "file_idx")


FCS_SQL = """
SELECT event_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS CD3_x, CAST(CASE WHEN r <= 700 THEN 1 WHEN r <= 1900 THEN 2 ELSE 3 END AS INTEGER) AS file_idx
FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS r FROM events)
"""


def fcs_slices(spark, d):
    paths = _fcs_set(spark, d)
    df = fcs.read_fcs(spark, paths, slices=4)
    return stats.part_sizes(df).select(F.col("part"), "n")


FCS_SLICES_SQL = "SELECT CAST(s AS INTEGER) AS part, n // 4 + CASE WHEN s < n % 4 THEN 1 ELSE 0 END AS n FROM (SELECT count(*) AS n FROM events), range(4) t(s)"


def fcs_channels(spark, d):
    _, keywords = fcs.read_header(_fcs_set(spark, d)[0])
    raw, readable = naming.marker_names(naming.channel_table(keywords))
    return spark.createDataFrame([(i + 1, r, n, c) for i, (r, n, c) in enumerate(zip(raw, readable, naming.clean_names(readable), strict=True))], "channel int, raw string, readable string, clean string")


def csv_set_scan(spark, d):
    """The whole table as a set of three; rows without a key are in the last, as the SQL's CASE has them."""
    folder = fcs_files.shared_folder(spark)
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    first, second = (F.coalesce(F.col("p_partkey") <= n, F.lit(False)) for n in (50, 120))
    paths = []
    for i, rows in enumerate((first, second & ~first, ~second)):
        paths.append(os.path.join(folder, f"c{i}.csv"))
        part.filter(rows).write.csv(paths[-1], header=True)
    return tables.read_csv_set(spark, paths, file_idx=True)


CSV_SQL = "SELECT CAST(p_partkey AS DOUBLE) AS x1, p_retailprice AS x2, CAST(CASE WHEN p_partkey <= 50 THEN 1 WHEN p_partkey <= 120 THEN 2 ELSE 3 END AS INTEGER) AS file_idx FROM part"


def stat_sql(cols, digits):
    return ", ".join(f"round(avg({c}), {digits}) + 0.0 AS {c}_mean, round(stddev_pop({c}), {digits}) + 0.0 AS {c}_sdev" for c in cols)


def _pairs_sql(e):
    return f"""WITH u AS (SELECT i + 1 AS id, CAST(i % 4 AS DOUBLE) AS gx, CAST(i // 4 AS DOUBLE) AS gy FROM range(12) t(i))
SELECT CAST(a.id AS INTEGER) AS a, CAST(b.id AS INTEGER) AS b, round({e}, 9) + 0.0 AS dist FROM u a CROSS JOIN u b"""


def _x_sql(e):
    return f"SELECT x, round({e}, 9) + 0.0 AS w FROM (SELECT CAST(i AS DOUBLE) AS x FROM range(11) t(i))"


def _epochs_sql(n, e):
    return f"SELECT CAST(epoch AS INTEGER) AS epoch, round({e}, 6) + 0.0 AS r FROM (SELECT i + 1 AS epoch, CAST(i AS DOUBLE) / {max(n - 1, 1)} AS t FROM range({n}) t(i))"


_LOW = 0.1 * (1 - 1.1**5)

#: name: (query, SQL or None)
CATALOGUE: dict[str, tuple] = {
    "flagship_cluster_means": (flagship, FLAGSHIP_SQL),
    "select_columns": (select_columns, "SELECT l_tax, l_quantity FROM lineitem"),
    "select_by_place": (select_by_place, "SELECT p_retailprice AS price, p_partkey AS key FROM part"),
    "asinh_transform": (asinh_transform, "SELECT event_id, round(asinh(value / 5), 6) + 0.0 AS value FROM events"),
    "asinh_sql_function": (asinh_sql, "SELECT event_id, round(asinh(value / 1.23), 6) + 0.0 AS value FROM events"),
    "zscale": (zscale, "SELECT " + ", ".join(f"round(x{j}, 5) + 0.0 AS {c}" for j, c in enumerate(LINE)) + f" FROM ({SCALED})"),
    "asinh_zscale": (asinh_zscale, f"SELECT event_id, round(x0, 5) + 0.0 AS value FROM ({oracles.z_scaled('(SELECT event_id, asinh(value / 5) AS value FROM events)', ['value'], 'event_id, ')})"),
    "apply_cols": (apply_cols, "SELECT p_partkey, p_size * 2 AS p_size, round(p_retailprice * 3, 3) + 0.0 AS p_retailprice FROM part"),
    "array_spread_gather": (array_spread, "SELECT vec_id, " + ", ".join(f"CAST(embedding[{j + 1}] AS DOUBLE) AS v{j}" for j in range(2, 62)) + ", 0.0::DOUBLE + embedding[1]::DOUBLE + embedding[2]::DOUBLE + embedding[63]::DOUBLE + embedding[64]::DOUBLE AS ends FROM embeddings"),
    "compensate_linear": (compensate_linear, COMPENSATE_SQL),
    "dstat": (dstat, f"SELECT {stat_sql(LINE, 4)} FROM lineitem"),
    "dstat_buckets": (dstat_buckets, f"SELECT l_returnflag, {stat_sql(LINE, 4)} FROM lineitem GROUP BY l_returnflag"),
    "dmedian": (dmedian, "SELECT " + ", ".join(f"round(median({c}), 6) + 0.0 AS {c}_median" for c in LINE) + " FROM lineitem"),
    "dmedian_buckets": (dmedian_buckets, "SELECT event_type, round(median(value), 6) + 0.0 AS value_median FROM events GROUP BY event_type"),
    "bucket_mean": (bucket_mean, "SELECT l_returnflag, count(*) AS n, " + ", ".join(f"round(avg({c}), 4) + 0.0 AS {c}_mean" for c in LINE) + " FROM lineitem GROUP BY l_returnflag"),
    "map_buckets": (map_buckets, "SELECT l_linestatus, " + ", ".join(f"round(max({c}) - min({c}), 4) + 0.0 AS {c}_range" for c in LINE[:2]) + " FROM lineitem GROUP BY l_linestatus"),
    "cat_map_buckets": (cat_map_buckets, "SELECT event_type, round(max(value) - min(value), 6) + 0.0 AS value FROM events GROUP BY event_type"),
    "global_mean": (global_mean, "SELECT " + ", ".join(f"round(sum({c}) / count({c}), 4) + 0.0 AS {c}_mean" for c in LINE) + " FROM lineitem"),
    "map_reduce_sum": (map_reduce_sum, "SELECT count(*) AS n, sum(l_quantity) AS total FROM lineitem"),
    "dcount": (dcount, "SELECT CAST(i AS INTEGER) AS id, count(label) AS n FROM range(1, 13) t(i) LEFT JOIN embeddings ON label + 1 = i GROUP BY i"),
    "dcount_buckets": (dcount_buckets, "SELECT CAST(b AS INTEGER) AS bucket, CAST(i AS INTEGER) AS id, count(label) AS n FROM range(1, 6) s(b) CROSS JOIN range(1, 12) t(i) LEFT JOIN embeddings ON label + 1 = i AND vec_id % 4 + 1 = b GROUP BY b, i"),
    "file_counts": (file_counts, "SELECT CAST(row_number() OVER (ORDER BY event_type) AS INTEGER) AS file_idx, count(*) AS n FROM events GROUP BY event_type"),
    "slice_sizes": (slice_sizes, "SELECT CAST(s AS INTEGER) AS slice, n // 7 + CASE WHEN s <= n % 7 THEN 1 ELSE 0 END AS n FROM (SELECT count(*) AS n FROM events), range(1, 8) t(s)"),
    "part_sizes": (part_sizes, "SELECT CAST(event_id % 4 AS INTEGER) AS part, count(*) AS n FROM events GROUP BY 1"),
    "som_grid": (som_grid, "SELECT CAST(i + 1 AS INTEGER) AS id, CAST(i % 4 AS DOUBLE) AS gx, CAST(i // 4 AS DOUBLE) AS gy FROM range(12) t(i)"),
    "grid_dist_chebyshev": (lambda spark, d: _pairs(spark, "chebyshev"), _pairs_sql("greatest(abs(a.gx - b.gx), abs(a.gy - b.gy))")),
    "grid_dist_euclidean": (lambda spark, d: _pairs(spark, "euclidean"), _pairs_sql("sqrt((a.gx - b.gx) * (a.gx - b.gx) + (a.gy - b.gy) * (a.gy - b.gy))")),
    "kernel_gaussian": (lambda spark, d: _kernel(spark, g.gaussian_kernel, 2.0), _x_sql("exp(-(x / 2) * (x / 2) / 2) / (2 * sqrt(2 * pi()))")),
    "kernel_bubble": (lambda spark, d: _kernel(spark, g.bubble_kernel, 5.0), _x_sql("sqrt(greatest(0, 1 - x * x / 25))")),
    "kernel_threshold": (lambda spark, d: _kernel(spark, g.threshold_kernel, 9.5), _x_sql("CAST(1e-6 AS DOUBLE) + CASE WHEN x <= 8 THEN 1 ELSE 0 END")),
    "radius_linear": (lambda spark, d: _radius(spark, g.linear_radius, 50.0, 0.001, 30), _epochs_sql(30, "50 + (CAST(0.001 AS DOUBLE) - 50) * t")),
    "radius_exp": (lambda spark, d: _radius(spark, EXP5, 10.0, 0.1, 20), _epochs_sql(20, f"{oracles.number(_LOW)} + {oracles.number(10 - _LOW)} * pow({oracles.number((0.1 - _LOW) / (10 - _LOW))}, t)")),
    "som_init": (som_init, "SELECT id, " + ", ".join(f"round(c{j} * s{j} + m{j}, 4) + 0.0 AS c{j}" for j in range(4)) + f" FROM {oracles.codebook(NOISE, MAP.grid)}, (SELECT " + ", ".join(f"avg({c}) AS m{j}, stddev_pop({c}) AS s{j}" for j, c in enumerate(LINE)) + " FROM lineitem)"),
    "som_epoch_sums": (som_epoch_sums, oracles.trained(SCALED, NOISE, 5, 5, [5.0]) + "\nSELECT id, n, " + ", ".join(f"round(s{j}, 4) + 0.0 AS s{j}" for j in range(4)) + " FROM sums0"),
    "som_train_1epoch": (_train(1), _train_sql(1)),
    "som_train_2epoch": (_train(2), _train_sql(2)),
    "som_train_bubble": (_train(3, g.bubble_kernel, g.linear_radius, 4.0, 2.0), _train_sql(3, "bubble", g.linear_radius, 4.0, 2.0)),
    "som_train_threshold": (_train(3, g.threshold_kernel, g.linear_radius, 4.0, 0.5), _train_sql(3, "threshold", g.linear_radius, 4.0, 0.5)),
    "som_train_20epoch": (_train(20), _train_sql(20)),
    "som_map_bmu": (_map(), _map_sql()),
    "som_map_cityblock": (_map("cityblock"), _map_sql("cityblock")),
    "som_map_chebyshev": (_map("chebyshev"), _map_sql("chebyshev")),
    "som_map_expressions": (map_by_expressions, _map_sql()),
    "cluster_sizes": (cluster_sizes, f"""SELECT CAST(i AS INTEGER) AS "index", count(vec_id) AS n FROM range(1, 26) t(i) LEFT JOIN ({_map_sql()}) ON "index" = i GROUP BY i"""),
    "cluster_means": (cluster_means, CLUSTER_MEANS_SQL),
    "knn_codes": (knn_codes, KNN_SQL),
    "embed_default": (_embed(), _embed_sql()),
    "embed_k4": (_embed(k=4, adjust=2.3, smooth=0.1, m=4.5), _embed_sql(4, 2.3, 0.1, 4.5)),
    "embed_no_cutoff": (_embed(k=25), _embed_sql(25)),
    "embed_difference": (_embed(k=6, edge="difference"), _embed_sql(6, edge="difference")),
    "metacluster_expand": (metacluster_expand, f"""SELECT vec_id, "index", CAST(([{', '.join(map(str, META))}])["index"] AS INTEGER) AS metacluster FROM ({_map_sql()})"""),
    "metacluster_assign": (metacluster_assign, None),
    "fcs_roundtrip_scan": (fcs_scan, FCS_SQL),
    "fcs_slices": (fcs_slices, FCS_SLICES_SQL),
    "fcs_channels": (fcs_channels, "SELECT * FROM (VALUES (1, 'E-id', 'E-id', 'E_id'), (2, 'V', 'CD3-x', 'CD3_x')) t(channel, raw, readable, clean)"),
    "csv_set_scan": (csv_set_scan, CSV_SQL),
}


def queries() -> dict:
    return {name: q for name, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
