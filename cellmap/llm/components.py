"""Connected components of a table of links, united in parts and then by alternating large and small stars.

A part is some half a million links, which one task turns into stars, each component's least node in the middle. One part
is all there is to a small table; the stars of more parts are united over all of them in rounds. A round is two joins on
the larger end of links, with ends of very many links split; the table that is left is written to the shared folder, so
rounds don't pile up in the plan and survive lost executors. Nothing is gathered on the driver but a count and a checksum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, settle

#: Links that one task unites, about (some 100 bytes each while it does).
PART = 500_000


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the links of one part, every node but the least of its component, and that least node."""
    held = [np.stack([c.to_numpy() for c in b.columns[:2]]) for b in batches]
    if not sum(x.shape[1] for x in held):
        return
    nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    u, v = at.reshape(2, -1)
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while not np.array_equal(root, further := root[root]):
            root = further
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    inner = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(nodes[root[inner]])], names=["u", "v"])


def _state(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return r["n"], int(r["h"])


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` has ``u`` and ``v`` (long), in any direction, repeated or not.

    Returns ``node`` and ``root`` for every node that isn't the least of its component; ``root``
    is that least node. Links of a node to itself are ignored; no links give an empty table.
    """
    star = settle(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    parts = -(-star.count() // PART)
    if parts:
        star = settle(star.coalesce(parts).mapInArrow(_unite, "u long, v long"), "united")
    if parts <= 1:
        return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = _state(star)
    for _ in range(most_rounds):
        # Large star: the larger neighbours of u, and u's least neighbour (or u).
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = join_by_key(both.filter("v > u"), least, "u", before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of u, and u itself, with the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_by_key(large, least, "u", before[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = settle(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = _state(star)
        if now == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components did not settle")
