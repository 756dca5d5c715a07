"""Content sort against a dictionary."""

import hashlib
import random

import pytest

from cellmap.llm.exact_dedup import content_sort_dedup

DELETE = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def brute(rows):
    groups = {}
    for i, (doc, text) in enumerate(rows):
        groups.setdefault((text or "").translate(DELETE), []).append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for norm, members in groups.items():
        members.sort()
        best = rows[members[0][3]][0]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        out += [(rows[m[3]][0], best, len(members), k == 0, sha) for k, m in enumerate(members)]
    return sorted(out, key=repr)


CASES = {
    "plain": [(1, "a b"), (2, "ab"), (3, "a\tb "), (4, "c"), (5, None), (6, ""), (7, " \n"), (8, "é\xa0")],
    "ties": [(5, "x y"), (3, "x\ny"), (4, "xy"), (None, "x y"), (3, "x\ny")],
    "null ids": [(None, "q"), (None, "q"), (None, None)],
    "one": [(1, "z" * 100_000)],
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    df = spark.createDataFrame(CASES[name], "doc_id long, text string")
    got = sorted((tuple(r) for r in content_sort_dedup(df, carry=False).collect()), key=repr)
    assert got == brute(CASES[name])


def test_hot_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot text", "hot  text", "hottext ", "hot\ttext"])) for i in range(700)]
    rows += [(1000 + i, "start " * 20 + rng.choice("abc") * rng.randint(1, 3)) for i in range(900)]
    rows += [(3000 + i, f"unique {i}") for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in content_sort_dedup(df, carry=False).collect()), key=repr)
    assert got == brute(rows)
    kept = content_sort_dedup(df, kept_only=True).filter("kept").select("row.*")
    assert kept.columns == ["doc_id", "text"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, kept string, row string, keep_id string")
    out = content_sort_dedup(df)
    assert out.count() == 0 and out.select("row.*").columns == df.columns
    df = spark.createDataFrame([(1, "a", "k", "r", "i"), (2, "a", "l", "s", "j")], df.schema)
    assert [tuple(r) for r in content_sort_dedup(df, kept_only=True).filter("kept").select("row.*").collect()] == [(1, "a", "k", "r", "i")]
