"""Near copies by SimHash fingerprints, decided by the exact Jaccard similarity of whole texts' word shingles.

Fingerprints within a radius are found by ``simhash``'s partitions, thresholds, probes and verification; the texts of
what they link are then compared whole. A similarity of 0.8 moves up to 13 and more of 64 bits, so the radius is the widest
up to ``RADIUS`` that a plan carries at ``PLAN_COST`` a fingerprint, which gets smaller as the table grows. Rows of one component
are settled by that. An exact way finds the links beyond the radius among rows that are still apart:

Two sets with a similarity of 0.8 or more share one of their first n - ceil(0.8 n) + 1 members in
any common order (n: the members of either), so rows that share none of these are never compared
and no pair is lost. Which order is taken only changes the cost: shingles that a sample finds
often come last. Rows of a group are compared with one of them, then those of groups that this
hasn't connected with another one, and then all that are still apart in a group with each other, in cells of
bounded size. Sizes, places and the difference of small sketches rule out, without fail, what can't be
similar, and only what is left goes on to the comparison of whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, forget_shuffles, join_by_key, settle
from .components import PART, components

SHINGLE = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Rows whose shingles are counted for the order, and most shingles that it puts last.
SAMPLE = 20_000
MOST_COMMON = 200_000
ROWS_A_BATCH = 500_000
#: Rows of a group that are compared as one; larger groups are split into cells of two parts each.
CELL = 512
#: Row numbers that are sent to all executors (16 bytes each) to find their texts; more are joined by a shuffle.
MOST_SENT = 1_000_000
#: Numbers of shingles by hash: two sets differ in at least as many members as their sketches do.
SKETCH = 128
#: Least and widest radius of fingerprints, and most that a plan may cost a fingerprint, in ``simhash``'s units.
RADIUS = (4, 13)
PLAN_COST = 4_000.0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles as sorted 64-bit digests; a text of fewer words is one shingle, one without words as well."""
    words = (text or "").encode().lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))], np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(w) - SHINGLE + 1
    h = w[:n].copy()
    for j in range(1, SHINGLE):
        h = h * _STEP + w[j : j + n]
    return np.unique(h)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, parts, held = [], [], 0
        for row, text in zip(batch.column(0), batch.column(1), strict=True):
            rows.append(row.as_py())
            parts.append(shingles(text.as_py()))
            held += len(parts[-1])
            if held >= ROWS_A_BATCH:
                yield _lists(rows, parts)
                rows, parts, held = [], [], 0
        if rows:
            yield _lists(rows, parts)


def _lists(rows: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), items], names=["row", "items"])


def sketch_of(h: np.ndarray) -> bytes:
    return np.minimum(np.bincount((h >> np.uint64(33)).astype(np.int64) % SKETCH, minlength=SKETCH), 255).astype(np.uint8).tobytes()


HEADS = "key long, row long, size int, place int, sketch binary"


def _heads(common: np.ndarray, rank: np.ndarray):
    """Every row's first shingles in the common order, with the row's size and the place in it; the first has the row's sketch."""

    def flush(held: list[tuple[int, int, np.ndarray, bytes]]) -> pa.RecordBatch:
        lengths = [len(x[2]) for x in held]
        keys = np.concatenate([x[2] for x in held]).view(np.int64)
        row, size = (np.repeat(x, lengths) for x in (np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int32)))
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
        at = np.cumsum(lengths) - lengths
        index = np.full(len(keys), -1, np.int64)
        index[at] = np.arange(len(held))
        sketch = pa.array([x[3] for x in held], pa.binary()).take(pa.array(index, mask=index < 0))
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in (keys, row, size, place)), sketch], names=[x.split()[0] for x in HEADS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, many = [], 0
            for row, text in zip(batch.column(0), batch.column(1), strict=True):
                h = shingles(text.as_py())
                n, sketch = len(h), sketch_of(h)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    h = h[np.argsort(np.where(common[at] == h, rank[at], 0), kind="stable")]
                held.append((row.as_py(), n, h[: n - -(-OVER * n // UNDER) + 1], sketch))
                many += len(held[-1][2])
                if many >= ROWS_A_BATCH:
                    yield flush(held)
                    held, many = [], 0
            if held:
                yield flush(held)

    return run


def _common(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of rows holds more than twice, sorted, with their ranks by frequency."""
    n = rows.count()
    if n > SAMPLE:
        rows = rows.filter(F.pmod(F.xxhash64("row"), F.lit(n // SAMPLE + 1)) == 0)
    counts = rows.mapInArrow(_sets, "row long, items array<long>").select(F.explode("items").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    found = counts.filter("n > 2").orderBy(F.desc("n"), "key").limit(MOST_COMMON).toArrow()
    keys = np.array(found.column("key")).astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (len(keys) - np.arange(len(keys)))[order]


def _attach(pairs: DataFrame, facts: DataFrame, column: str) -> DataFrame:
    """``column`` of both rows of each pair, as ``of_u`` and ``of_v``."""
    u, v = (facts.select(F.col("row").alias(c), F.col(column).alias(f"of_{c}")) for c in "uv")
    return join_by_key(pairs.join(v, "v"), u, "u", counted=pairs, salt=["v"])


def _may_be_close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches and sizes let them be similar."""
    for batch in batches:
        u, v, n, m, a, b = batch.columns
        differ = np.zeros(batch.num_rows, np.int64)
        for at in range(0, batch.num_rows, 8_192):
            x, y = (np.frombuffer(b"".join(c.slice(at, 8_192).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in (a, b))
            differ[at : at + len(x)] = np.abs(x - y).sum(axis=1)
        close = pa.array((OVER + UNDER) * differ <= (UNDER - OVER) * (n.to_numpy().astype(np.int64) + m.to_numpy()))
        yield pa.RecordBatch.from_arrays([u.filter(close), v.filter(close)], names=["u", "v"])


def _similar(rows: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """Of ``pairs`` (``u``, ``v``) those whose whole sets are similar enough."""
    of = settle(pairs.select(F.explode(F.array("u", "v")).alias("row")).distinct(), f"rows_{name}")
    few = of.count() <= MOST_SENT
    sets = settle(rows.join(F.broadcast(of) if few else of, "row", "left_semi").mapInArrow(_sets, "row long, items array<long>"), f"sets_{name}")
    both = F.size(F.array_intersect("of_u", "of_v"))
    found = settle(_attach(pairs, sets, "items").filter((OVER + UNDER) * both >= OVER * (F.size("of_u") + F.size("of_v"))).select("u", "v"), f"similar_{name}")
    discard(sets)
    return found


def _nearest_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links between fingerprints of one part those of a spanning forest, links of few differing bits before others."""
    held = [np.stack([c.to_numpy() for c in b.columns]) for b in batches]
    if not sum(x.shape[1] for x in held):
        return
    fp = np.concatenate(held, axis=1)
    fp = fp[:, np.argsort(np.bitwise_count((fp[0] ^ fp[1]).view(np.uint64)), kind="stable")]
    nodes, at = np.unique(fp, return_inverse=True)
    root, taken = list(range(len(nodes))), np.zeros(fp.shape[1], bool)
    for i, (x, y) in enumerate(zip(*at.reshape(2, -1).tolist(), strict=True)):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[max(x, y)] = min(x, y)
            taken[i] = True
    yield pa.RecordBatch.from_arrays([pa.array(x[taken]) for x in fp], names=["u", "v"])


def fingerprint_links(rows: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` of rows (``row``, ``text``) whose fingerprints the probes link and whose whole sets are similar enough.

    Rows of equal fingerprints are compared with the least of them, and those with each other along a spanning forest
    of the links within the radius.
    """
    fp = settle(simhash.fingerprints(rows, "row", "text", SHINGLE), "fingerprints")
    distinct = settle(fp.groupBy("fp").agg(F.min("_id").alias("least")), "distinct_fingerprints")
    pairs = join_by_key(fp, distinct, "fp").filter("_id <> least").select(F.col("least").alias("u"), F.col("_id").alias("v"))
    n, counts = simhash.bit_counts(distinct)
    if n > 1:
        radius, plan = simhash.widest(n, counts, *RADIUS, PLAN_COST)
        links = settle(simhash.probed(distinct, radius, plan).distinct(), "fingerprint_links")
        forest = links.coalesce(-(-links.count() // PART) or 1).mapInArrow(_nearest_forest, "u long, v long")
        u, v = (distinct.select(F.col("fp").alias(c), F.col("least").alias(f"least_{c}")) for c in "uv")
        near = join_by_key(join_by_key(settle(forest, "fingerprint_forest"), u, "u"), v, "v")
        pairs = pairs.unionByName(near.select(F.least("least_u", "least_v").alias("u"), F.greatest("least_u", "least_v").alias("v")))
    return _similar(rows, settle(pairs, "fingerprint_pairs"), "fingerprints")


def _may(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sizes and places let two rows be similar, were the shared shingle the first they share."""
    return (UNDER * F.least(n, m) >= OVER * F.greatest(n, m)) & ((OVER + UNDER) * F.least(n - i, m - j) >= OVER * (n + m))


def close_pairs(group: np.ndarray, part: np.ndarray, split: np.ndarray, root: np.ndarray, size: np.ndarray, place: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of rows of one group that may be similar and have different roots; equal groups are neighbours.

    In a cell that holds two parts (``split``) only rows of different parts are compared.
    """
    n, at, d, found = len(group), np.arange(len(group)), 0, []
    while True:
        d += 1
        at = at[at + d < n]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        i, j = at, at + d
        most = np.minimum(size[i] - place[i], size[j] - place[j])
        may = (root[i] != root[j]) & (~split[i] | (part[i] != part[j])) & (UNDER * np.minimum(size[i], size[j]) >= OVER * np.maximum(size[i], size[j])) & ((OVER + UNDER) * most >= OVER * (size[i] + size[j]))
        i, j = i[may], j[may]
        for k in range(0, len(i), 4_096):
            a, b = i[k : k + 4_096], j[k : k + 4_096]
            differ = np.abs(sketch[a].astype(np.int32) - sketch[b]).sum(axis=1)
            close = (OVER + UNDER) * differ <= (UNDER - OVER) * (size[a] + size[b])
            found.append((a[close], b[close]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each cell; rows of one cell may lie in several batches."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        key, low, high, part, row, root, size, place = (table.column(c).to_numpy() for c in ("key", "low", "high", "part", "row", "root", "size", "place"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        new = np.ones(len(key), np.int64)
        new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        i, j = close_pairs(np.cumsum(new), part, low != high, root, size.astype(np.int64), place.astype(np.int64), sketch)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(row[i], row[j])), pa.array(np.maximum(row[i], row[j]))], names=["u", "v"])

    def cell(batch: pa.RecordBatch, at: int) -> tuple:
        return tuple(batch.column(c)[at].as_py() for c in ("key", "low", "high"))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last, cut = cell(batch, batch.num_rows - 1), batch.num_rows
        while cut and cell(batch, cut - 1) == last:
            cut -= 1
        if cut:
            yield out([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and cell(held[-1], 0) != last:
            yield out(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield out(held)


def _distinct_groups(groups: DataFrame) -> DataFrame:
    """Of groups of the same rows the one whose shingle comes first.

    The order is common to all rows, so that shingle has the first places in each of them, and no pair is lost.
    """
    h = [F.xxhash64("row", F.lit(i)) for i in (1, 2)]
    of = settle(groups.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.bit_xor(x).alias(a) for x, a in zip(h, "ab", strict=True)], F.sum("place").alias("places")), "group_marks")
    first = of.groupBy("n", "a", "b").agg(F.min(F.struct("places", "key")).alias("k")).select("k.key")
    return join_by_key(groups, first, "key", counted=of, total=groups.count())


def _open(groups: DataFrame, stars: DataFrame, name: str) -> DataFrame:
    """Rows of the groups that hold several components, with their ``root``."""
    roots = settle(groups.join(stars.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row")), f"{name}_roots")
    apart = roots.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("n")).filter("a < b").select("key", "n")
    return settle(join_by_key(roots, apart, "key"), name)


def near_copies(df: DataFrame, row_col: str, text_col: str) -> DataFrame:
    """``node`` and ``root`` of every row that isn't the least of its component.

    ``row_col`` (long) differs in every row. Rows are linked if the sets of their texts' five-word shingles have a
    Jaccard similarity of 0.8 or more, whatever their fingerprints; words are as in ``simhash``. Texts without words are equal, and so are null ones.
    An empty table gives an empty table. Other columns don't matter. A text of any length is compared whole.
    """
    rows = df.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))
    stars = components(fingerprint_links(rows))
    forget_shuffles(df.sparkSession)
    heads = settle(rows.mapInArrow(_heads(*_common(rows)), HEADS), "heads")
    sketches = settle(heads.filter("place = 0").select("row", "size", "sketch"), "sketches")
    slim = heads.drop("sketch")
    shared = settle(heads.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared_shingles")
    forget_shuffles(df.sparkSession)
    slim = settle(join_by_key(slim, shared.select("key"), "key", counted=shared, total=heads.count()), "groups")
    discard(heads)
    whole, slim = slim, settle(_distinct_groups(slim), "distinct_groups")
    discard(whole)
    groups = _open(slim, stars, "open")
    for turn, order in enumerate((F.col("row"), F.xxhash64("row"))):
        one = groups.groupBy("key").agg(F.min(F.struct(order.alias("o"), "row", "size", "place", "root")).alias("p")).select("key", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("row", "size", "place", "root")])
        pairs = join_by_key(groups, one, "key").filter("root <> p_root").filter(_may(F.col("p_size"), F.col("p_place"), F.col("size"), F.col("place")))
        pairs = settle(pairs.select(F.col("p_row").alias("u"), F.col("row").alias("v"), F.col("p_size").alias("n"), F.col("size").alias("m")).distinct(), f"met_{turn}")
        both = _attach(pairs.select("u", "v", F.col("n").alias("size_u"), F.col("m").alias("size_v")), sketches, "sketch").select("u", "v", "size_u", "size_v", "of_u", "of_v")
        found = _similar(rows, settle(both.mapInArrow(_may_be_close, "u long, v long"), f"pairs_{turn}"), f"{turn}")
        stars = components(found.unionByName(stars.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        groups = _open(slim, stars, f"open_{turn}")
        discard(pairs)
    cells = groups.withColumn("parts", F.ceil(F.col("n") / CELL).cast("int")).withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other"))
    cells = cells.join(sketches.select("row", "sketch"), "row").select("key", "low", "high", "part", "row", "root", "size", "place", "sketch")
    pairs = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "row").mapInArrow(_cells, "u long, v long")
    rest = _similar(rows, settle(pairs.distinct(), "pairs_rest"), "rest")
    return components(rest.unionByName(stars.select(F.col("node").alias("u"), F.col("root").alias("v"))))
