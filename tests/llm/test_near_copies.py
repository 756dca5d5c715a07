"""Near copies against brute force over whole texts."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from cellmap.llm import common
from cellmap.llm import near_copies as nc
from cellmap.llm import simhash


def brute(rows):
    """Roots by the exact similarity of five-word shingles; the least place is the root."""
    sets = []
    for text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if 9 * both >= 4 * (len(a) + len(sets[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [f"W{i}" for i in range(500)]
    common = " ".join(f"licence{i}" for i in range(12))
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.5:
            t = rng.choice(texts[-40:]).split(" ")
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = rng.choice(words)
            texts.append(" ".join(t))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 4, 5, 6, 60, 150, 400]))) + (" " + common) * (rng.random() < 0.5))
    return texts


def test_near_dedup(spark):
    """Near copies of similarity 0.8 and more go, whatever their fingerprints; less similar documents stay."""
    texts = corpus(3)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs.repartition(3), "").collect()}
    roots = brute(texts)
    assert kept == {i for i, r in enumerate(roots) if i == r}
    assert 20 < len(kept) < len(texts) - 20


@pytest.mark.parametrize(("cell", "few"), [(8, 0), (512, 65_536)])
def test_drifting_copies(spark, monkeypatch, cell, few):
    """A large group whose members are similar to some of the others only; split into small cells it loses no link."""
    monkeypatch.setattr(nc, "CELL", cell)
    monkeypatch.setattr(common, "FEW", few)
    rng = random.Random(5)
    base, texts = [f"b{i}" for i in range(90)], []
    for _ in range(160):
        t = list(rng.choice(texts[-60:]).split(" ")) if texts and rng.random() < 0.4 else list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(f"x{i}y{j}" for j in range(40)) + " shared tail of words that many texts have in common" for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4)
    found = {r["node"]: r["root"] for r in nc.near_copies(rows, "row", "text").collect()}
    assert [found.get(i, i) for i in range(len(texts))] == brute(texts)
    assert 20 < len({*brute(texts)}) - 60 < 150


def edited(seed, n, edits):
    """Unlike texts, each followed by a copy with some words replaced."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        t = [f"t{i}w{j}" for j in range(rng.randrange(40, 200))]
        texts.append(" ".join(t))
        for _ in range(rng.randint(*edits)):
            t[rng.randrange(len(t))] = f"n{rng.randrange(10**9)}"
        texts.append(" ".join(t))
    return texts


def test_fingerprints_link_first(spark):
    """Of pairs that lie apart from all others, fingerprints link those within the radius whose whole texts are similar."""
    texts = edited(2, 150, (0, 4))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(4)
    found = {(r["u"], r["v"]) for r in nc.fingerprint_links(rows).collect()}
    fp = [simhash.fingerprint(t, nc.SHINGLE) for t in texts]
    n, counts = simhash.bit_counts(spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in {*fp}], "fp long"))
    radius, _ = simhash.widest(n, counts, *nc.RADIUS, nc.PLAN_COST)
    roots = brute(texts)
    similar = {(i, i + 1) for i in range(0, len(texts), 2) if roots[i + 1] == i}
    assert radius > 4
    assert found == {(i, j) for i, j in similar if (fp[i] ^ fp[j]).bit_count() <= radius}
    assert any((fp[i] ^ fp[j]).bit_count() > 4 for i, j in found) and found < similar | {(-1, -1)}
    assert len(similar) < len(texts) // 2


def test_stage_compares_what_fingerprints_leave(spark, monkeypatch):
    """Rows that fingerprints have linked are not looked for again; no fingerprint link is needed for a right result."""
    texts, compared = edited(7, 40, (1, 1)), {}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    roots, inner, links = brute(texts), nc._similar, nc.fingerprint_links

    def similar(rows, pairs, name):
        compared[name] = pairs.count()
        return inner(rows, pairs, name)

    monkeypatch.setattr(nc, "_similar", similar)
    kept = {i for i, r in enumerate(roots) if i == r}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == kept
    assert compared.pop("fingerprints") >= len(texts) - len(kept) - 2 > 20
    assert sum(compared.values()) <= 6
    monkeypatch.setattr(nc, "fingerprint_links", lambda rows: links(rows).limit(0))
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == kept


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(2, 400))
        a = np.unique(rng.integers(0, 1 << 62, n))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(0, 1 << 62, int(n * rng.uniform(0, 0.2)))]))
        both = len(np.intersect1d(a, b))
        sketch = np.stack([np.frombuffer(nc.sketch_of(x.astype(np.uint64)), np.uint8) for x in (a, b)])
        i, _ = nc.close_pairs(np.zeros(2), np.zeros(2), np.zeros(2, bool), np.arange(2), np.array([len(a), len(b)]), np.zeros(2, np.int64), sketch)
        if 9 * both >= 4 * (len(a) + len(b)):
            assert len(i) == 1


def test_disk(spark, monkeypatch):
    """Each text is written once, and sets of shingles go as soon as they have been compared."""
    rng, sizes, sets = random.Random(9), {}, []

    def settle(df, name, codec="zstd"):
        found = common.settle(df, name, codec)
        files = [f.removeprefix("file:").replace("///", "/") for f in found.inputFiles()]
        sizes[name] = sum(map(os.path.getsize, files))
        sets.extend(files * name.startswith("sets_"))
        return found

    for m in (corpus_pipeline, nc):
        monkeypatch.setattr(m, "settle", settle)
    docs = spark.createDataFrame([(i, rng.randbytes(20_000).hex(" ", 4)) for i in range(40)], "doc_id long, text string")
    settle(docs, "texts")
    assert corpus_pipeline.near_dedup(spark, docs.unionByName(docs.limit(3)), "").count() == 40
    assert sizes["rows"] < 1.3 * sizes["texts"]
    assert sets and not any(map(os.path.exists, sets))


def test_repeated_and_null_ids(spark):
    """Rows are decided one by one: an unrelated row stays whatever its identifier, and one row of each group stays."""
    text = " ".join(f"w{i}" for i in range(80))
    near, other = text.replace("w3 ", "q "), " ".join(f"z{i}" for i in range(50))
    rows = [(1, text), (2, near), (2, other), (3, "third " * 9), (None, text + " more"), (None, other + " end"), (5, None), (6, ""), (7, "third " * 9)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, row string, _row int")
    kept = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(((r[0], r[1]) for r in kept), key=repr) == sorted([(1, text), (2, other), (3, "third " * 9), (5, None)], key=repr)
    assert corpus_pipeline.near_dedup(spark, docs, "").columns == docs.columns
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0
