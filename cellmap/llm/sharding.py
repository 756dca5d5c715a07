"""Sharding by a hierarchical weighted hash tree, in DataFrame operations only.

A tree has regions, racks and shards. A row descends it: at every level each child makes
a draw of its own from a hash of the row's key, and the smallest draw wins. The draw of a child
of weight w is -ln(u) / w with u uniform in (0, 1]; a rack weighs what its shards do together, and
a region what its racks do. So a child is chosen in proportion to its weight, and a change of
weights moves rows only at the levels where sums change: weight that goes from one shard of a rack
to another moves rows within that rack alone. A shard that joins as a region of its own changes
no other sum: it takes rows from the others, and no row moves between those.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Rows that one ranking group holds, about.
ROWS_A_BIN = 5_000


@dataclass(frozen=True)
class Leaf:
    shard: int
    rack: int
    region: int
    weight: float = 1.0


def even_tree(n_shards: int, shards_a_rack: int = 2, racks_a_region: int = 2) -> list[Leaf]:
    """Shards 0 to n-1 of weight 1 in the given arrangement."""
    return [Leaf(s, s // shards_a_rack, s // (shards_a_rack * racks_a_region)) for s in range(n_shards)]


def grown(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a rack and a region of its own; it takes rows from all others, which exchange none."""
    return [*tree, Leaf(*(1 + max((getattr(x, k) for x in tree), default=-1) for k in ("shard", "rack", "region")), weight)]


def _pick(key: list[Column], level: int, children: Column) -> Column:
    """Of the children (structs of number and weight) the one of the smallest draw; of equal draws, the smallest number."""

    def draw(c: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(level), c["id"]), 11)
        return F.struct((-F.log((bits.cast("double") + F.lit(1.0)) / F.lit(float(1 << 53))) / c["weight"]).alias("d"), c["id"].alias("id"))

    return F.array_min(F.transform(children, draw))["id"]


def _children(weights: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("id"), F.lit(float(w)).alias("weight")) for k, w in sorted(weights.items())])


def hash_tree(df: DataFrame, key_cols: list[str], trees: dict[str, list[Leaf]]) -> DataFrame:
    """Add, for each named tree, ``<name>_region``, ``<name>_rack`` and ``<name>``: the shard.

    Columns of these names are replaced. Null keys are keys like others, and rows of equal keys go together. No
    shuffle; no row depends on another. A rack lies in one region and a shard in one rack.
    """
    key = [F.col(c) for c in key_cols]
    for name, tree in trees.items():
        racks: dict[int, dict[int, float]] = {}
        shards: dict[int, dict[int, float]] = {}
        for x in tree:
            if x.weight <= 0 or any(x.rack in r for g, r in racks.items() if g != x.region) or any(x.shard in s for s in shards.values()):
                raise ValueError("a shard needs one place and a weight above zero")
            racks.setdefault(x.region, {}).setdefault(x.rack, 0.0)
            racks[x.region][x.rack] += x.weight
            shards.setdefault(x.rack, {})[x.shard] = x.weight
        regions = {g: sum(r.values()) for g, r in racks.items()}
        names = [f"{name}_region", f"{name}_rack", name]
        df = df.withColumn(names[0], _pick(key, 0, _children(regions)))
        for level, (at, below) in enumerate(((names[0], racks), (names[1], shards)), 1):
            table = F.create_map(*[c for k, v in sorted(below.items()) for c in (F.lit(k), _children(v))])
            df = df.withColumn(names[level], _pick(key, level, F.element_at(table, F.col(at))))
    return df


def place(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 16) -> DataFrame:
    """Place every row in one of ``n_shards`` shards by its identifier.

    Returns ``<id_col>``, ``size`` (UTF-8 bytes and 1), ``text_crc32``, ``law`` (``key``),
    ``region``, ``rack``, ``shard``, ``slot`` (gapless from 0 in each shard) and
    ``grown_shard`` (with one more shard). A null text has no bytes; its checksum is that of
    the empty text. Null identifiers are one key. Repeated rows get a slot each. An empty table gives
    an empty table. Other columns don't matter. A text of any length is read whole.

    Slots come from counts of small hashed bins and a rank within each bin, so that no task
    holds a whole shard. Text stays where it is read; only the small columns are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    small = df.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = settle(hash_tree(small, ["_id"], {"shard": even_tree(n_shards), "grown_shard": grown(even_tree(n_shards))}).withColumn("_no", F.monotonically_increasing_id()), "placed")
    bins = max(1, -(-placed.count() // (n_shards * ROWS_A_BIN)))
    placed = placed.withColumn("_bin", F.pmod(F.xxhash64("_no", F.lit(7)), F.lit(bins)).cast("int"))
    ahead = Window.partitionBy("shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "_bin").agg(F.count(F.lit(1)).alias("_n")).select("shard", "_bin", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    within = Window.partitionBy("shard", "_bin").orderBy("_no")
    return placed.join(first, ["shard", "_bin"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), F.col("shard_region").alias("region"), F.col("shard_rack").alias("rack"), "shard",
        (F.col("_ahead") + F.row_number().over(within) - 1).cast("long").alias("slot"), "grown_shard",
    )
