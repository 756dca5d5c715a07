"""Held-out accuracy, and the exchange of pseudo-labels."""

import random

import numpy as np

from cellmap.llm import cotraining as c


def docs(n, seed=9):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 120))]
        text = " ".join(words) if good else " ".join(w.upper() + rng.choice(["!!", "###", "$$$"]) for w in words)
        source = rng.choice(["src1", "src2"]) if rng.random() < (0.9 if good else 0.1) else "spam"
        rows.append((i, text, "en", source, len(text), int(good)))
    return rows


def test_accuracy(spark):
    rows = docs(900)
    df = spark.createDataFrame([r[:5] for r in rows] + [(None, None, None, None, None), (5000, "", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:300]] + [(1, 1 - rows[1][5]), (None, 1), (2, None)], "doc_id long, quality int")
    out = c.classify(df, labels, most_labelled=200, most_taught=60)
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 902 and out.columns[:5] == df.columns
    unseen = rows[300:]
    assert sum(got[r[0]]["kept"] == bool(r[5]) for r in unseen) / len(unseen) > 0.97
    good = [r for r in unseen if r[5]]
    assert sum(got[r[0]]["kept"] for r in good) / len(good) > 0.98
    meta = sum((got[r[0]]["meta_score"] > 0.5) == bool(r[5]) for r in unseen) / len(unseen)
    assert meta > 0.8 and all(0 <= r["score"] <= 1 for r in got.values())


def test_views_teach_each_other():
    """With few labels, a view that is weak alone gains from the other's pseudo-labels."""
    rng = np.random.default_rng(1)
    y = (rng.random(2000) < 0.5).astype(float)
    t = (y[:, None] * 2 - 1 + rng.normal(size=(2000, 3)) * 0.8).astype(np.float32)
    m = (y[:, None] * 2 - 1 + rng.normal(size=(2000, 3)) * 0.8).astype(np.float32)
    alone = c.co_train(t[:24], m[:24], y[:24], None)
    both = c.co_train(t[:24], m[:24], y[:24], c.Pool(t[24:1000], m[24:1000]), most_taught=50, sure=0.9)
    right = [((x.log_odds(t[1000:], m[1000:])[2] > 0) == y[1000:]).mean() for x in (alone, both)]
    assert right[1] >= right[0] - 0.005 and right[1] > 0.95


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x")], "doc_id long, text string, kept string")
    for labels in ([], [(1, 1)]):
        out = c.classify(df, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert [r["kept"] for r in out] == [True, True]
    assert c.classify(df.limit(0), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_table_is_the_pool(spark):
    """The exchange takes the surest rows of the whole table, as brute force over all rows does."""
    rng = np.random.default_rng(5)
    rows = docs(600, 3)
    df = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    views = c.settled_views(df, "doc_id", "text")
    got = views.orderBy("no").collect()
    t, m = c._unpacked([r["t"] for r in got], [r["m"] for r in got])
    y = np.array([rows[r["id"]][5] for r in got], float)
    some = rng.permutation(600)[:100]
    text, meta = c.Logistic.fit(t[some], y[some]), c.Logistic.fit(m[some], y[some])
    numbers = np.array([r["no"] for r in got])
    pool = c.TablePool(views)
    taken = {"text": np.zeros(0, np.int64), "meta": np.zeros(0, np.int64)}
    for _ in range(2):
        found = pool.surest(text, meta, 40, 0.8)
        for pupil, odds, own in (("meta", text.log_odds(t), m), ("text", meta.log_odds(m), t)):
            at, good = c.surest_rows(odds, taken[pupil], numbers, 40, 0.8)
            assert np.array_equal(found[pupil][0], own[at]) and np.array_equal(found[pupil][1], good) and len(at) > 10
            taken[pupil] = np.append(taken[pupil], numbers[at])
            assert set(taken[pupil].tolist()) == set(pool.taken[pupil].tolist())


def test_clashing_columns(spark):
    rows = [(*r[:5], i, "x", "y", 0.5) for i, r in enumerate(docs(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _t int, _source string, view_t string, score double")
    labels = spark.createDataFrame([(r[0], r[5]) for r in docs(60)], "doc_id long, quality int")
    out = c.classify(df, labels)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_t", "_source", "view_t", "text_score", "meta_score", "score", "kept"]
    assert sorted(r["_t"] for r in out.collect()) == list(range(60))


def test_scores_by_hand(spark):
    """The table's scores are those of the model applied row by row."""
    rows = docs(300, 6)
    df = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:120]], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in c.classify(df, labels).collect()}
    for r in rows:
        g = got[r[0]]
        odds = [np.log(g[k] / (1 - g[k])) for k in ("text_score", "meta_score", "score")]
        if abs(odds[2]) < 12 and all(abs(o) < 12 for o in odds):
            prior = np.log((sum(x[5] for x in rows[:120]) + 1) / (120 - sum(x[5] for x in rows[:120]) + 1))
            assert abs(odds[0] + odds[1] - prior - odds[2]) < 1e-3
