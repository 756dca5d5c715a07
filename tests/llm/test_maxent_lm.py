"""Counts and base scores against brute force; the model against the unigram baseline on held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cellmap.llm import maxent_lm as m


def is_held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def toks(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows):
    counts = Counter(w for d, t in rows if not is_held_out(d) for w in toks(t))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, (d, t) in enumerate(rows):
        ws = toks(t)
        out[i] = d, is_held_out(d), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
    return sorted(out.values(), key=repr)


def corpus(n=400):
    """Two kinds of text whose words predict each other."""
    rng = random.Random(8)
    rows = [(None, None), (3, ""), (3, "A b"), (3, "A b")]
    for i in range(n):
        kind = i % 2
        words = [f"k{kind}w{min(int(rng.expovariate(0.08)), 200)}" if rng.random() < 0.7 else f"k{kind}the" for _ in range(rng.randint(5, 120))]
        rows.append((1000 + i, " ".join(words).upper() if i % 5 == 0 else " ".join(words)))
    return rows


@pytest.mark.parametrize("head", [20, 100_000])
def test_scores(spark, head):
    rows = corpus()
    out = m.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), head=head).collect()
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out), key=repr)
    for a, b in zip(sorted(got, key=lambda r: (str(r[0]), r[2])), sorted(brute(rows), key=lambda r: (str(r[0]), r[2]))):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
    held = [r for r in out if r["held_out"]]
    assert len(held) > 20 and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in out)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_empty(spark):
    assert m.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_nothing_to_learn_from(spark):
    ids = [i for i in range(40) if is_held_out(i)]
    out = m.score(spark.createDataFrame([(i, "x y") for i in ids], "doc_id long, text string")).collect()
    assert all(r["held_out"] and r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 and abs(r["score"]) < 1e-9 for r in out) and len(out) == len(ids)


def vocabulary(spark, n=3000):
    rng = random.Random(2)
    words = [f"{rng.choice('abcdefgh')}{rng.choice('xyz')}{i}" for i in range(700)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(n // 40)]
    df = spark.createDataFrame([(t, False) for _, t in rows], "text string, held_out boolean")
    return m.build_vocabulary(m.count_words(df))


def test_probabilities(spark):
    """Classes, slots and words within slots add up to one; the model without weights is the smoothed unigram; a step makes the batch likelier."""
    v = vocabulary(spark)
    shared = m.OWN_CLASSES
    assert math.isclose(v.mass.sum(), v.total + v.distinct + (m.CLASSES - shared) * m.SLOTS)
    words = [*v.words]
    codes = v.codes(words, m.checksums(words))
    classes, slots = m.targets(codes)
    inside = np.zeros_like(v.mass)
    np.add.at(inside, (classes, slots), 10 ** v.log_count)
    inside[shared:] += 1
    assert np.allclose(inside, v.mass) and len(set(zip(classes[classes < shared], slots[classes < shared]))) == len(v.own)
    model, rng = m.Model.fresh(v), np.random.default_rng(0)
    model.of_class += rng.normal(size=model.of_class.shape).astype(np.float32)
    model.of_slot += rng.normal(size=model.of_slot.shape).astype(np.float32)
    first = rng.random(len(codes)) < 0.1
    first[0] = True
    f, g = m.features(codes, first, len(model.of_class))
    assert f.shape == (3, len(codes)) and g.shape == (1, len(codes)) and f.max() < len(model.of_class) and f.min() >= 0
    p, q = np.exp(model.classes(f).astype(float)), np.exp(model.slots(g, classes).astype(float))
    p, q, at = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True), np.arange(len(codes))
    assert np.allclose(10 ** model.log10(codes, first), p[at, classes] * q[at, slots], rtol=1e-3)
    fresh = m.Model.fresh(v)
    assert np.allclose(fresh.log10(codes, first), np.log10(v.mass[classes, slots] / v.mass.sum()), atol=1e-5)
    squares, before = np.zeros((2, len(fresh.of_class)), np.float32), fresh.log10(codes, first).mean()
    for _ in range(10):
        fresh.step(f, g, classes, slots, squares)
    assert fresh.log10(codes, first).mean() > before


def test_features_stay_within_texts():
    h = np.arange(1, 9, dtype=np.int64)
    first = np.zeros(8, bool)
    first[[0, 5]] = True
    f, g = m.features(h, first, 4096)
    again, more = m.features(h[5:], first[5:], 4096)
    assert np.array_equal(f[:, 5:], again) and np.array_equal(g[:, 5:], more)


def test_rows_grow():
    sizes = [m.feature_rows(n) for n in (0, 10**6, 10**8, 10**10, 10**13)]
    assert sizes == sorted(sizes) and sizes[0] == 4096 and sizes[-1] == 64 * sizes[0]


def test_long_text_and_odd_words(spark):
    long = " ".join(f"w{i % 9000}" for i in range(300_000))
    rows = [(1, long), (2, " \t\n lead and trail \x0b"), (4, "É é\xa0x \x1c y"), (5, "A" * 100_000), *corpus(60)]
    df = spark.createDataFrame([(a, t, 1, "x", 0) for a, t in rows], "doc_id long, text string, row long, codes string, held_out int")
    out = m.score(df, head=50).collect()
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in out), key=lambda r: (str(r[0]), r[2]))
    for a, b in zip(got, sorted(brute(rows), key=lambda r: (str(r[0]), r[2])), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
