"""Placement laws."""

import zlib
from collections import Counter

from cellmap.llm import sharding as s


def test_place(spark):
    rows = [(i, f"text {i % 7}") for i in range(3000)] + [(None, None), (5, "text 5"), (5, "text 5"), (9000, "é" * 50_000)]
    out = s.place(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(out) == len(rows)
    by_id = {}
    for r in out:
        assert by_id.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16 and r["law"] == "key"
        assert (r["region"], r["rack"]) == (r["shard"] // 4, r["shard"] // 2)
    sizes = Counter(r["shard"] for r in out)
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(n))
    assert max(sizes.values()) < 1.4 * len(rows) / 16 and len(sizes) == 16
    moved = sum(r["grown_shard"] == 16 for r in out)
    assert 0.5 * len(rows) / 17 < moved < 1.6 * len(rows) / 17
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in out) == want
    assert s.place(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_weights(spark):
    """Shares follow weights, and a changed weight moves rows only into the subtrees that gained."""
    leaves = [s.Leaf(0, 0, 0, 1.0), s.Leaf(1, 0, 0, 3.0), s.Leaf(2, 1, 1, 2.0), s.Leaf(3, 2, 1, 2.0)]
    df = spark.range(0, 8000)

    def shards(tree):
        return {r["id"]: (r["a_region"], r["a_rack"], r["a"]) for r in s.hash_tree(df, ["id"], {"a": tree}).collect()}

    before = shards(leaves)
    n = Counter(a for *_, a in before.values())
    assert all(abs(n[x.shard] / 8000 - x.weight / 8) < 0.02 for x in leaves)
    assert all(v in {(x.region, x.rack, x.shard) for x in leaves} for v in before.values())
    after = shards([*leaves[:3], s.Leaf(3, 2, 1, 4.0)])  # rack 2 and region 1 gain
    moved = [(before[k], after[k]) for k in after if after[k] != before[k]]
    assert moved and all((b[0] == 1 and a[0] == 0) or (b[1] == 2 and a[0] == b[0]) for a, b in moved)


def test_movement_is_confined(spark):
    """Weight that goes from one shard of a rack to the other moves rows within that rack alone; a new shard takes rows into itself."""
    tree, df = s.even_tree(16), spark.range(0, 20_000)
    shifted = [s.Leaf(0, 0, 0, 1.5), s.Leaf(1, 0, 0, 0.5), *tree[2:]]
    rows = s.hash_tree(df, ["id"], {"a": tree, "b": shifted, "c": s.grown(tree)}).collect()
    moved = [r for r in rows if r["a"] != r["b"]]
    assert moved and all((r["a"], r["b"]) == (1, 0) for r in moved)
    assert all(r["c"] in (r["a"], 16) for r in rows) and any(r["c"] == 16 for r in rows)


def test_two_trees_joined(spark):
    """Plans stay small: two placements can be joined and filtered on their shards."""
    one, two = (s.hash_tree(spark.range(0, 500), ["id"], {n: s.even_tree(16)}) for n in ("a", "b"))
    assert one.join(two, "id").filter("a = 3 and b = 3").count() == one.filter("a = 3").count()


def test_equal_rows(spark):
    rows = [(None, "x")] * 3000 + [(1, "y")]
    out = s.place(spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, shard string, slot int")).collect()
    for shard in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))
