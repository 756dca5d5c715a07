"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link if at most ``radius`` bits differ. Bits that go together are
grouped into partitions, and each partition gets a threshold of its own: if the thresholds
t_i satisfy sum(t_i + 1) = radius + 1, two linked fingerprints differ in at most t_i bits of
some partition (t_i = -1: the partition isn't probed). A dynamic program picks the thresholds
of least cost, from the number of fingerprints and how often bits differ, alone and together, over all of them. A
partition with threshold t is probed by leaving out each t of its bits: linked fingerprints
agree in the rest for one choice at least. All pairs that meet are verified in full.

Equal fingerprints are one node. Fingerprints that meet in a bucket are compared in sorted
blocks, and of the links found only a spanning forest is handed on, so a dense group gives
rows in proportion to its size. Large buckets are dealt into cells that hold two parts each.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_by_key, settle
from .components import components

BITS = 64
SEED = 42
#: Fingerprints of a bucket that are compared as one; larger buckets are split.
CELL = 2_048
#: Cost of writing one probe, in units of one comparison.
PROBE_COST = 40.0
#: Cost of one more choice of left-out bits, whatever the table holds.
MASK_COST = 100_000.0


def fingerprint(text: str, words_a_shingle: int = 4) -> int:
    """Majority of the shingles' XXH64 bits, unsigned; zero for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= words_a_shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = (np.cumsum(lengths + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    h = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words_a_shingle - 1 :], strict=False)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 65_536):
        part = np.array(h[at : at + 65_536], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, words_a_shingle: int) -> DataFrame:
    """``_id`` and ``fp`` (the 64 bits as a signed long) of every row; a null text has no words."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py() or "", words_a_shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["_id", "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"_id {kind}, fp long")


# ---------------------------------------------------------------- partitions and thresholds


def bit_counts(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both; over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for batch in batches:
            fp = np.array(batch.column(0)).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(fp)
        i, j = np.triu_indices(BITS)
        yield pa.RecordBatch.from_arrays([pa.array([*i.tolist(), -1], pa.int32()), pa.array([*j.tolist(), -1], pa.int32()), pa.array([*total[i, j].tolist(), n], pa.int64())], names=["i", "j", "n"])

    rows = distinct.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    counts, n = np.zeros((BITS, BITS)), 0
    for r in rows:
        if r["i"] < 0:
            n = r["n"]
        else:
            counts[r["i"], r["j"]] = counts[r["j"], r["i"]] = r["n"]
    return n, counts


def group_bits(n: int, counts: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of about equal size; each starts with a free bit and takes those that go with it most."""
    p = np.diag(counts) / max(1, n)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    together = np.abs((counts / max(1, n) - np.outer(p, p)) / np.outer(spread, spread))
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [free.pop(0)]
        while len(group) < size:
            best = max(free, key=lambda b: (together[b, group].sum(), -b))
            free.remove(best)
            group.append(best)
        groups.append(sorted(group))
    return groups


def differences(n: int, counts: np.ndarray) -> np.ndarray:
    """For each two bits, the chance that two fingerprints differ in both; on the diagonal, in that bit."""
    both = counts / max(1, n)
    p = np.diag(both)
    first, second, none = p[:, None] - both, p[None, :] - both, 1 - p[:, None] - p[None, :] + both
    out = 2 * (both * none + first * second)
    out[np.diag_indices(len(p))] = 2 * p * (1 - p)
    return out


def within(differ: np.ndarray, t: int) -> float:
    """Chance that at most t of a group's bits differ.

    ``differ`` is the group's part of ``differences``. The number of differing bits gets the beta-binomial
    distribution of the same mean and variance, so bits that go together make small numbers likelier.
    """
    if t < 0:
        return 0.0
    m = len(differ)
    if t >= m:
        return 1.0
    mean = float(np.trace(differ))
    p = min(max(mean / m, 1e-9), 1 - 1e-9)
    variance = float(differ.sum()) - mean * mean
    lean = min((variance / (m * p * (1 - p)) - 1) / (m - 1), 0.999) if m > 1 else 0.0
    if lean < 1e-6:
        return float(sum(math.comb(m, k) * p**k * (1 - p) ** (m - k) for k in range(t + 1)))
    a, b = p * (1 - lean) / lean, (1 - p) * (1 - lean) / lean

    def log_beta(x: float, y: float) -> float:
        return math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y)

    return min(1.0, sum(math.comb(m, k) * math.exp(log_beta(k + a, m - k + b) - log_beta(a, b)) for k in range(t + 1)))


@dataclass(frozen=True)
class Plan:
    groups: list[list[int]]
    thresholds: list[int]
    cost: float

    def masks(self) -> list[int]:
        """The bits that each probe keeps."""
        out = []
        for bits, t in zip(self.groups, self.thresholds, strict=True):
            if t >= 0:
                out += [sum(1 << b for b in bits if b not in left) for left in itertools.combinations(bits, t)]
        return out


def allocate(n: int, counts: np.ndarray, radius: int) -> Plan:
    """The cheapest partitions and thresholds, by dynamic programming over partitions and spent radius."""
    differ = differences(n, counts)
    best = None
    for parts in range(1, radius + 2):
        groups = group_bits(n, counts, parts)
        costs = [[0.0, *(math.comb(len(g), t) * (n * PROBE_COST + MASK_COST) + n * n / 2 * within(differ[np.ix_(g, g)], t) for t in range(min(radius, len(g)) + 1))] for g in groups]
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in costs:
            step: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, ts) in table.items():
                for k in range(min(radius + 2 - spent, len(c))):
                    if spent + k not in step or cost + c[k] < step[spent + k][0]:
                        step[spent + k] = cost + c[k], [*ts, k - 1]
            table = step
        cost, ts = table[radius + 1]
        if best is None or cost < best.cost:
            best = Plan(groups, ts, cost)
    return best


def widest(n: int, counts: np.ndarray, least: int, most: int, cost: float) -> tuple[int, Plan]:
    """The widest radius from ``least`` to ``most`` whose plan costs at most ``cost`` a fingerprint (``least`` if none does), and that plan.

    Less than 1,000 fingerprints may cost what 1,000 do.
    """
    for radius in range(most, least - 1, -1):
        plan = allocate(n, counts, radius)
        if plan.cost <= cost * max(n, 1_000):
            break
    return radius, plan


# ---------------------------------------------------------------- probe and verify


def forest(group: np.ndarray, fp: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Places of links that connect what is linked within each group; equal groups are neighbours."""
    n = len(fp)
    root, links = np.arange(n), []
    at, d = np.arange(n), 0
    while True:
        d += 1
        at = at[at + d < n]
        at = at[group[at] == group[at + d]]
        if not len(at):
            return links
        i = at[root[at] != root[at + d]]
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        if len(i):
            for a in i.tolist():
                x, y = a, a + d
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    links.append((a, a + d))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up


def _verify(radius: int):
    def out(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        probe, key, cell, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
        new = np.ones(len(fp), np.int64)
        new[1:] = (probe[1:] != probe[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])
        links = forest(np.cumsum(new), fp.view(np.uint64), radius)
        i, j = (np.array(x, np.int64) for x in (zip(*links, strict=True) if links else ([], [])))
        return pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []  # rows of one cell may lie in several batches
        for batch in batches:
            if not batch.num_rows:
                continue
            now = tuple(np.array(c) for c in batch.columns)
            last = tuple(x[-1] for x in now[:3])
            same = np.logical_and.reduce([x == y for x, y in zip(now[:3], last, strict=True)])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield out([*held, tuple(x[:cut] for x in now)])
                held = [tuple(x[cut:] for x in now)]
            elif held and tuple(x[-1] for x in held[-1][:3]) != last:
                yield out(held)
                held = [now]
            else:
                held.append(now)
        if held:
            yield out(held)

    return run


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links ``u``, ``v`` that connect all fingerprints of ``distinct`` (column ``fp``) as all links within ``radius`` do."""
    n, counts = bit_counts(distinct)
    if n < 2:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    return probed(distinct, radius, allocate(n, counts, radius))


def probed(distinct: DataFrame, radius: int, plan: Plan) -> DataFrame:
    """As ``links``, by the partitions and thresholds of ``plan``."""
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in plan.masks()]
    probes = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("probe", "key"))
    sizes = probes.groupBy("probe", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CELL)
    sizes = settle(sizes.select("probe", "key", F.ceil(F.col("n") / CELL).cast("int").alias("parts")), "large_buckets")
    probes = probes.join(sizes, ["probe", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    probes = probes.withColumn("part", part).withColumn("other", other)
    # A cell holds two parts of a large bucket; every two parts meet in one.
    cell = F.least("part", "other") * F.col("parts") + F.greatest("part", "other")
    cells = probes.select("probe", "key", cell.alias("cell"), "fp").repartition("probe", "key", "cell").sortWithinPartitions("probe", "key", "cell", "fp")
    return cells.mapInArrow(_verify(radius), "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_a_shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per row of ``df``: ``<id_col>``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    ``component_id`` is the smallest identifier that links reach, the row's own included; null
    identifiers have no part in that, and it is null where a component has no other. A null
    or blank text has fingerprint zero and links like others. Repeated rows are rows of their own.
    An empty table gives an empty table. Other columns don't matter. A text of any length is read whole.
    """
    all_fp = settle(fingerprints(df, id_col, text_col, words_a_shingle), "fingerprints")
    distinct = settle(all_fp.groupBy("fp").agg(F.min("_id").alias("least")), "distinct_fingerprints")
    stars = components(links(distinct, radius))
    rooted = settle(distinct.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    found = join_by_key(rooted.select("fp", "root"), rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return join_by_key(all_fp, settle(found, "found"), "fp").select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
