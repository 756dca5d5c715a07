"""Fingerprints and groups against brute force."""

import random

import numpy as np
import pytest
import xxhash

from cellmap.llm import components as star_components
from cellmap.llm import simhash as s
from cellmap.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_groups(rows, radius=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, f"{fps[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.4:
            t = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randint(0, 2)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i, " ".join(t)))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 5, 80, 300])))))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (None, rows[0][1]), (None, "alone here now and never"), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_groups(spark, seed):
    rows = corpus(250, seed)
    got = s.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_groups(rows)


def test_empty(spark):
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = s.near_duplicates(spark.createDataFrame([(4, "a b", 1, 2)], "doc_id long, text string, fp int, root int")).collect()
    assert [r["component_id"] for r in one] == [4]


@pytest.mark.parametrize("n", [0, 1, 2, 50])
def test_small_plans(n):
    """However few fingerprints there are, a plan has few probes."""
    assert len(s.allocate(n, np.eye(64) * n / 2, 4).masks()) <= 100


def test_estimates():
    """Chances of few differing bits, for free bits and for bits that go together, against draws."""
    rng = np.random.default_rng(2)
    for share in (0.0, 0.7):
        bits = rng.integers(0, 2, (3000, 16))
        common = rng.integers(0, 2, (3000, 1))
        bits = np.where(rng.random(bits.shape) < share, common, bits)
        differ = s.differences(len(bits), bits.T @ bits)
        d = (bits[:1500] != bits[1500:]).sum(axis=1)
        for t in (1, 2, 4, 6):
            assert abs(s.within(differ, t) - (d <= t).mean()) < 0.08
        assert s.within(differ, -1) == 0 and s.within(differ, 16) == 1


def test_large_buckets(spark, monkeypatch):
    """With tiny cells, groups are split and lose no link."""
    monkeypatch.setattr(s, "CELL", 8)
    rng = random.Random(4)
    fps = set()
    for base in (0, 0x0F0F0F0F0F0F0F0F, 0xFFFF00000000FFFF):
        for _ in range(120):
            x = base
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = components(s.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4)).collect()
    group = {x: x for x in signed} | {r["node"]: r["root"] for r in found}
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 4:
                assert group[signed[i]] == group[signed[j]]
    assert len(set(group.values())) == 3


@pytest.mark.parametrize("n", [1, 1_000, 10_000_000, 10**10])
def test_allocation_loses_nothing(n):
    """Whatever the plan, every pair within the radius shares a probe."""
    rng = np.random.default_rng(0)
    bits = rng.integers(0, 2, (500, 64))
    bits[:, 1] = bits[:, 0]
    plan = s.allocate(n, (bits.T @ bits) * (n / 500), 4)
    assert sum(t + 1 for t in plan.thresholds) == 5 and sorted(b for g in plan.groups for b in g) == list(range(64))
    masks = plan.masks()
    r = random.Random(1)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), r.randint(0, 4)):
            b ^= 1 << k
        assert any(a & m == b & m for m in masks)


@pytest.mark.parametrize("part", [20, 500_000])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(star_components, "PART", part)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(-5, 60)] + [(200 + rng.randrange(80), 200 + rng.randrange(80)) for _ in range(60)] + [(7, 7), (999, 1000), (1000, 999)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for x in near:
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert found.get(x, x) == min(seen)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_fingerprint():
    for t in [None, "", "a", "A b C", "x y z w v", "word " * 30, "é ñ à ü ö", "one two three four " * 2000]:
        assert s.fingerprint(t or "") == brute_fingerprint(t)
