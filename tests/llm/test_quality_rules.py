"""Statistics against plain Python, and rules on labelled rows."""

import random
import re

import pytest

from cellmap.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {p + k for at in windows.values() if len(at) > 1 for p in at for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def texts():
    rng = random.Random(2)
    out = [None, "", " ", "\n\n", "a", "a b", "a b c", "a a a", "a a a a", "a b c a b c", "a b c\na b c\n\n a b c", "#*$%&|<> x", "é ñ\xa0ü x\x0by", "x " * 5000, "a\nb\na\n"]
    for _ in range(200):
        out.append("".join(rng.choice(["a", "b", " ", "  ", "\n", "\t", "#", "c d", "ab"]) for _ in range(rng.randint(0, 60))))
    return out


def test_stats(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = q.with_stats(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id")
    for r, (_, t) in zip(df.collect(), rows):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), repr(t)[:80]


def test_learning():
    rng = random.Random(3)
    rows = []
    for i in range(900):
        bad = i % 4 == 0
        r = dict.fromkeys(q.FEATURES, 0.0) | {"words": 100.0 + i, "quality": 0 if bad else 1, "mean_word": rng.random()}
        r["symbol_share"] = 0.3 + rng.random() / 10 if bad and i % 8 else rng.random() / 10
        r["bang_share"] = 0.9 if bad and i % 8 == 0 else rng.random() / 10
        rows.append(r)
    rules = q.learn_rules(rows)
    wrong = sum((any(all(c.holds(r) for c in rule) for rule in rules)) == (r["quality"] == 1) for r in rows)
    assert rules and wrong < 10
    assert q.learn_rules([]) == [] and q.learn_rules([r for r in rows if r["quality"]]) == []


def test_operator(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = [(i, (good + f" {i}") if i % 3 else " ".join(f"w{k}###" for k in range(80)) + f" {i}", "x") for i in range(300)] + [(None, None, None), (900, good, None), (900, good, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    out = q.quality_rules(df, labels).collect()
    assert len(out) == len(docs)
    for r in out:
        if r["row"]["doc_id"] is not None and r["row"]["doc_id"] < 300:
            assert r["kept"] == bool(r["row"]["doc_id"] % 3)
    assert [r["kept"] for r in out if r["row"]["doc_id"] is None] == [False]
    assert q.quality_rules(df.limit(0), labels).count() == 0
    none = q.quality_rules(df, labels.limit(0))
    assert {r["kept"] for r in none.filter("row.doc_id = 1").collect()} == {True}
    assert none.select("row.*").columns == df.columns


@pytest.mark.parametrize("rules", [[], [(q.Condition("words", True, 10.0),)]])
def test_verdict_is_an_expression(spark, rules):
    df = q.with_stats(spark.createDataFrame([(1, "a " * 20)], "doc_id long, text string"))
    assert df.select(q.verdict(rules).alias("k")).first()["k"] == (not rules)
