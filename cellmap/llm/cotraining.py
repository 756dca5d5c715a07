"""Quality classification by co-training.

Two logistic classifiers see different views of a document: its text, and its page metadata
(source, language, stated length). Each is fitted on labelled rows; then, for some rounds,
each scores all rows that the labelled sample doesn't hold and labels those it is surest of for the
other one. Both are calibrated on labelled rows that neither was fitted on, and their calibrated
log-odds are added as those of two views that are independent given the class. What reaches a fit is
bounded: ``most_labelled`` labelled rows (of the smallest hashed identifiers), and ``most_taught``
rows a round, class and view. Features are made once and settled; every round is a pass over them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, smallest_hashed

TEXT_BUCKETS = 512
META_BUCKETS = 128
STATS = 10


def text_features(text: str) -> np.ndarray:
    """Shares of hashed byte pairs, and statistics of characters, words and lines; all in 0 to 1 but the last two."""
    out = np.zeros(TEXT_BUCKETS + STATS, np.float32)
    raw = text.encode()
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8)
    if len(b) > 1:
        pairs = (b[:-1].astype(np.uint32) * 40_503 ^ b[1:].astype(np.uint32) * 2_654_435_761) >> np.uint32(7)
        out[:TEXT_BUCKETS] = np.sqrt(np.bincount(pairs % TEXT_BUCKETS, minlength=TEXT_BUCKETS) / len(pairs))
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, m = max(1, len(words)), max(1, len(lines))
    kinds = np.bincount(_KIND[b], minlength=5) / len(b)
    out[TEXT_BUCKETS:] = [*kinds[:5], len(set(words)) / n, len(set(lines)) / m, sum(w[-1] == 33 for w in words) / n, np.log1p(n) / 10, min(1.0, len(b) / n / 50)]
    return out


_KIND = np.zeros(256, np.int64)
for _i in range(256):
    _c = chr(_i)
    _KIND[_i] = 4 if _i >= 128 else 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4
_KIND[[ord(c) for c in "#*$%&|<>!{}=~^_@+\\/"]] = 2  # with digits: what prose has little of


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Hashed buckets of source, language, both, and the magnitude of the length; null is a value of its own."""
    size = "none" if n_chars is None else str(int(2 * np.log2(max(1, n_chars))))
    return [zlib.crc32(x.encode()) % META_BUCKETS for x in (f"s:{source}", f"l:{lang}", f"sl:{source}:{lang}", f"n:{size}")]


def meta_matrix(rows: list[list[int]]) -> np.ndarray:
    x = np.zeros((len(rows), META_BUCKETS), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    return x


@dataclass
class Logistic:
    """Ridge-regularised logistic regression, fitted by Newton steps with conjugate gradients; then Platt-scaled."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 8) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1), np.float32)], axis=1)
        w, keep = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6) * len(x)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g, h = z.T @ (p - y) + keep * w, p * (1 - p) + 1e-6
            d, r = np.zeros_like(w), -g
            q, rr = r.copy(), r @ r
            for _ in range(40):
                if rr < 1e-8 * (g @ g) + 1e-12:
                    break
                hq = z.T @ (h * (z @ q)) + keep * q
                a = rr / (q @ hq)
                d, r = d + a * q, r - a * hq
                rr, old = r @ r, rr
                q = r + rr / old * q
            w = w + d
        return cls(mean, scale, w)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Slope and shift of the log-odds on rows that the fit hasn't seen."""
        if len(set(y.tolist())) == 2:
            r = np.clip(self.raw(x), -20, 20)
            platt = Logistic.fit(r[:, None].astype(np.float32), y, ridge=1e-3)
            self.slope = float(max(0.0, platt.weights[0] / platt.scale[0]))
            self.shift = float(platt.weights[1] - self.slope * platt.mean[0])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.slope * np.clip(self.raw(x), -20, 20) + self.shift


@dataclass
class CoTrained:
    text: Logistic | None
    meta: Logistic | None
    prior: float
    threshold: float

    def log_odds(self, t: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text view, metadata view, and both together."""
        if self.text is None:
            flat = np.full(len(t), self.prior)
            return flat, flat, flat
        a, b = self.text.log_odds(t), self.meta.log_odds(m)
        return a, b, a + b - self.prior


class Pool:
    """Unlabelled rows as two matrices; what ``co_train`` asks of a pool."""

    def __init__(self, t: np.ndarray, m: np.ndarray):
        self.t, self.m = t, m
        self.taken = {"text": set(), "meta": set()}

    def surest(self, text: Logistic, meta: Logistic, most: int, sure: float) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """For each view the rows that the other one is surest of, and their classes; no row is taught twice to a view."""
        out = {}
        for teacher, x, pupil, own in ((text, self.t, "meta", self.m), (meta, self.m, "text", self.t)):
            at, good = surest_rows(teacher.log_odds(x), np.array(sorted(self.taken[pupil]), np.int64), np.arange(len(x)), most, sure)
            self.taken[pupil].update(at.tolist())
            out[pupil] = own[at], good
        return out


def surest_rows(log_odds: np.ndarray, taken: np.ndarray, number: np.ndarray, most: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``most`` surest rows of each class that are sure enough and not taken, and the classes; of equals the smallest numbers."""
    places, classes = [], []
    for good in (1.0, 0.0):
        p = 1 / (1 + np.exp(-np.clip(log_odds if good else -log_odds, -30, 30)))
        free = np.flatnonzero((p >= sure) & ~np.isin(number, taken))
        best = free[np.lexsort((number[free], -p[free]))[:most]]
        places.append(best)
        classes.append(np.full(len(best), good))
    return np.concatenate(places), np.concatenate(classes)


def co_train(t: np.ndarray, m: np.ndarray, y: np.ndarray, pool: Pool | None, rounds: int = 4, most_taught: int = 400, sure: float = 0.95, keep_good: float = 0.995) -> CoTrained:
    """Fit both views on labelled rows (t, m, y) and a pool of unlabelled rows.

    Every fourth labelled row is kept for calibration, and for the threshold: the log-odds above
    which ``keep_good`` of its good rows are, but never above even odds. With no labelled rows,
    or rows of one class, the scores are the prior alone and everything is kept.
    """
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if len(y) < 8 or len(set(y.tolist())) < 2:
        return CoTrained(None, None, prior, -np.inf)
    aside = np.arange(len(y)) % 4 == 3
    rows = {"text": [(t[~aside], y[~aside])], "meta": [(m[~aside], y[~aside])]}
    for r in range(rounds + 1):
        text, meta = (Logistic.fit(*(np.concatenate(x) for x in zip(*rows[k], strict=True))) for k in ("text", "meta"))
        text.calibrate(t[aside], y[aside])
        meta.calibrate(m[aside], y[aside])
        if r == rounds or pool is None:
            break
        for pupil, new in pool.surest(text, meta, most_taught, sure).items():
            rows[pupil].append(new)
    model = CoTrained(text, meta, prior, 0.0)
    good = model.log_odds(t[aside], m[aside])[2][y[aside] == 1]
    model.threshold = float(min(0.0, np.quantile(good, 1 - keep_good))) if len(good) else 0.0
    return model


VIEW = ["source", "lang", "n_chars"]


def _free_names(df: DataFrame, names: list[str]) -> list[str]:
    """The names, each with as many underscores ahead as make it differ from all columns."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n in have:
            n = "_" + n
        out.append(n)
    return out


def _view(df: DataFrame, text_col: str) -> list[Column]:
    """Text and metadata; metadata that the table hasn't are null."""
    have = set(df.columns)
    return [df[text_col].cast("string"), *((df[c] if c in have else F.lit(None)).cast("long" if c == "n_chars" else "string") for c in VIEW)]


def _matrix(texts: list[str | None], sources: list, langs: list, sizes: list) -> tuple[np.ndarray, np.ndarray]:
    t = np.stack([text_features(x or "") for x in texts]) if texts else np.zeros((0, TEXT_BUCKETS + STATS), np.float32)
    return t, meta_matrix([meta_features(*x) for x in zip(sources, langs, sizes, strict=True)])


def _unpacked(t: list[bytes], m: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(t), "<f2").reshape(-1, TEXT_BUCKETS + STATS).astype(np.float32)
    return x, meta_matrix(m)


def settled_views(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``t`` (text features as half-precision numbers), ``m`` (metadata buckets) and ``no`` (a number of its own) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                t = [text_features(x or "").astype("<f2").tobytes() for x in batch.column(1).to_pylist()]
                m = [meta_features(*x) for x in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t, pa.binary()), pa.array(m, pa.list_(pa.int32()))], names=["id", "t", "m"])

    seen = docs.select(docs[id_col].alias("id"), *[c.alias(n) for c, n in zip(_view(docs, text_col), ["text", *VIEW], strict=True)])
    return settle(seen.mapInArrow(run, f"id {kind}, t binary, m array<int>").withColumn("no", F.monotonically_increasing_id()), "views")


def labelled_views(views: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both views and the class of the chosen identifiers (``id``, ``y``), one row each however often one occurs."""
    rows = views.join(F.broadcast(chosen), "id").groupBy(F.col("id").cast("string").alias("id")).agg(F.min(F.struct("no", "t", "m", "y")).alias("r")).select("id", "r.t", "r.m", "r.y").collect()
    rows.sort(key=lambda r: (zlib.crc32(r["id"].encode()), r["id"]))
    return *_unpacked([r["t"] for r in rows], [r["m"] for r in rows]), np.array([r["y"] for r in rows], float)


class TablePool:
    """All rows of a table of views as a pool: each task hands on its surest rows, and the surest of all of them are taken."""

    def __init__(self, views: DataFrame):
        self.views = views
        self.taken = {"text": np.zeros(0, np.int64), "meta": np.zeros(0, np.int64)}

    def surest(self, text: Logistic, meta: Logistic, most: int, sure: float) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        shared = self.views.sparkSession.sparkContext.broadcast((text, meta, self.taken))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            text, meta, taken = shared.value
            held: dict[tuple[str, bool], list[tuple]] = {}
            for batch in batches:
                no, m = batch.column("no").to_numpy(), batch.column("m").to_pylist()
                t, x = _unpacked(batch.column("t").to_pylist(), m)
                for pupil, odds in (("meta", text.log_odds(t)), ("text", meta.log_odds(x))):
                    at, good = surest_rows(odds, taken[pupil], no, most, sure)
                    for i, g in zip(at.tolist(), good.tolist(), strict=True):
                        held.setdefault((pupil, g), []).append((-abs(float(odds[i])), int(no[i]), t[i].astype("<f2").tobytes(), m[i]))
                for k in held:
                    held[k] = sorted(held[k], key=lambda r: r[:2])[:most]
            rows = [(*k, *r) for k, rs in held.items() for r in rs]
            names, types = ["pupil", "good", "order", "no", "t", "m"], [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)], names=names)

        found = settle(self.views.select("no", "t", "m").mapInArrow(run, "pupil string, good double, `order` double, no long, t binary, m array<int>"), "surest")
        out = {}
        for pupil in ("meta", "text"):
            rows = [r for good in (1.0, 0.0) for r in found.filter((F.col("pupil") == pupil) & (F.col("good") == good)).orderBy("order", "no").limit(most).collect()]
            t, m = _unpacked([r["t"] for r in rows], [r["m"] for r in rows])
            self.taken[pupil] = np.append(self.taken[pupil], [r["no"] for r in rows]).astype(np.int64)
            out[pupil] = (t if pupil == "text" else m), np.array([r["good"] for r in rows], float)
        return out


SCORES = "text_score double, meta_score double, score double, kept boolean"


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_labelled: int = 8_000, most_taught: int = 400) -> DataFrame:
    """``docs`` with ``text_score``, ``meta_score``, ``score`` (chances of good quality) and ``kept``.

    Columns of these names are replaced; any other column is carried. Documents with labels that
    disagree aren't fitted on. A null text counts as empty, null metadata as a value of its own; repeated
    rows get equal scores. An empty table gives an empty table. A text of any length is read whole.
    """
    agreed = (
        labels.filter(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("y"), F.max("quality").alias("y2")).filter("y = y2").select("id", F.col("y").cast("int").alias("y"))
    )
    views = settled_views(docs, id_col, text_col)
    chosen = settle(smallest_hashed(agreed.join(views.select("id").distinct(), "id", "left_semi"), "id", most_labelled), "chosen")
    pool = views.join(F.broadcast(chosen.select("id")), "id", "left_anti")
    model = co_train(*labelled_views(views, chosen), TablePool(pool), most_taught=most_taught)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in SCORES.split(", ")]
    base = docs.drop(*names)
    columns = base.columns
    viewed = base.select(*[base[c] for c in columns], *[c.alias(n) for c, n in zip(_view(base, text_col), _free_names(base, ["view_t", "view_s", "view_l", "view_n"]), strict=True)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + ", " + SCORES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = shared.value, len(columns)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                t, m = _matrix(*(batch.column(n + i).to_pylist() for i in range(4)))
                odds = [np.clip(x, -30, 30) for x in model.log_odds(t, m)]
                chance = [pa.array(1 / (1 + np.exp(-x))) for x in odds]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], *chance, pa.array(odds[2] >= model.threshold)], names=[*columns, *names])

    return viewed.mapInArrow(run, schema)
