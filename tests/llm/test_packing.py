"""Pieces against the library, and packings against their bounds."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cellmap.llm import packing as p

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    rng = random.Random(6)
    odd = ["", None, "Hello, World!", "a\x1cb\xa0c", "é É İ ß ΑΣ", "<|endoftext|> x<|startoftext|>", "don't I'LL 12345 ²", "日本語 テスト 🙂", "x" * 3000, "%%% ### a%%%"]
    return odd + [" ".join("".join(rng.choice("abcdeéÀ'!.1") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 900))) for _ in range(120)]


def test_tokens():
    tokenizer = Tokenizer.from_file(PATH)
    all_texts = [t or "" for t in texts()]
    known = p.WordIds(PATH)
    assert known.by_words
    for _ in range(2):  # words that are new, and words that are known
        ids, cuts = known.encode(pa.array(texts()))
        for t, a, b in zip(all_texts, cuts[:-1], cuts[1:], strict=True):
            assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids
    known.by_words = False
    again, _ = known.encode(pa.array(texts()))
    assert again.tolist() == ids.tolist()


@pytest.mark.parametrize("most", [1, 3_000, 40_000])
def test_tokens_beyond_what_is_kept(monkeypatch, most):
    """Words that were dropped, and words that never fit, get the same ids again."""
    monkeypatch.setattr(p, "MOST_BYTES", most)
    tokenizer, known = Tokenizer.from_file(PATH), p.WordIds(PATH)
    all_texts = texts()
    for at in [*range(0, len(all_texts), 20), 0, 100]:
        ids, cuts = known.encode(pa.array(all_texts[at : at + 20]))
        for t, a, b in zip(all_texts[at : at + 20], cuts[:-1], cuts[1:], strict=True):
            assert ids[a:b].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids
        assert all(k.words.nbytes + k.ids.nbytes <= max(most, 17) for k in (known.words, known.parts))


def test_kept_words_are_bounded():
    """What a worker keeps of words has a bound in bytes, however many words there are and however long."""
    known = p.WordIds(PATH)
    known.encode(pa.array(["first words"]))
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
        for at in range(0, 120_000, 10_000):
            known.encode(pa.array([" ".join(f"{'abcdefghij'[i % 10] * (i % 23)}x{i}" for i in range(at, at + 10_000))]))
            known.encode(pa.array([" ".join(f"{i}:" + "long-" * 300 for i in range(at // 20, at // 20 + 500))]))
        assert tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before < 2 * 16_000_000 + 1_000_000
    finally:
        tracemalloc.stop()


def test_blocks():
    column = pa.array(["a" * 10, None, "b" * 100, "", "c" * 30, "d" * 30, "e" * 50])
    assert [*p.blocks(column, 60)] == [(0, 2), (2, 3), (3, 6), (6, 7)] and [*p.blocks(pa.array([], pa.string()), 60)] == []


@pytest.mark.parametrize("capacity", [64, 1024])
def test_pack(spark, monkeypatch, capacity):
    monkeypatch.setattr(p, "GROUP", 40)
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id"), (3, "again"), (3, "again")]
    out = p.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, capacity=capacity).collect()
    want = []
    for doc, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want.append((doc, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((tuple(r)[:5] for r in out), key=repr) == sorted(want, key=repr)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r["length"] for r in out) // capacity)
    assert len(bins) <= least * 1.06 + 2


def test_empty(spark):
    assert p.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_operators():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 300).tolist()
    a, b = p.start(lengths, 100, 2, rng)
    for bins in (a, b, p.crossover(a, b, lengths, 100, rng), p.mutate(a, lengths, 100, rng), *p.evolve([a, b], lengths, 100, 5, rng)):
        assert sorted(i for x in bins for i in x) == list(range(300)) and all(sum(lengths[i] for i in x) <= 100 for x in bins)
    best = p.evolve([a, b], lengths, 100, 10, rng)[0]
    assert len(best) <= len(a)
    assert p._bins(p._flat(a, 300)) == [sorted(x) for x in a]


def test_equal_rows(spark):
    """However many rows are equal, no sequence overflows and the packing stays tight."""
    rows = [(7, "same words in every row " * 40)] * 9_000 + [(i, f"other {i} " * (i % 90)) for i in range(2_000)]
    out = p.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH)
    bins = out.groupBy("sequence_id").agg({"length": "sum"}).collect()
    sums = [r["sum(length)"] for r in bins]
    assert max(sums) <= 4096 and len(sums) <= 1.01 * sum(sums) / 4096 + 1 and out.count() == len(rows)


def test_genes_beat_best_fit():
    """Where plain best fit misses the bound, crossover is used and saves bins."""
    rng = np.random.default_rng(3)
    for low, high in ((1000, 2000), (700, 2100)):
        lengths, done = rng.integers(low, high, 1500).tolist(), {}
        first = p.start(lengths, 4096, p.POPULATION, rng)
        best = p.evolve(first, lengths, 4096, 12, rng, done)[0]
        assert done["crossovers"] >= 10
        assert len(best) < len(p.plain_best_fit(lengths, 4096)) and len(best) < min(map(len, first))


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b", 3, "x", 9), (2, "c", 3, "x", 9)], "doc_id long, text string, length int, sequence_id string, _row long")
    assert sorted(r["doc_id"] for r in p.pack(df, PATH).collect()) == [1, 2]
