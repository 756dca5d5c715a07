"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) P(slot | class, history) P(word | slot). The first two are
softmaxes over sums of weights of hashed features. The class sees the word before, the two
words before, and the word two places before alone (a skip); the slot within its class sees the
word before, joined with the class. The most frequent words
have slots of their own, so there the slot is the word; every other word, seen or not, shares the
slot of its hash with others, in a class by its ending, and follows its count there. With all
weights at zero the model is a smoothed unigram model.

Counts come from all training documents, and the number of feature rows grows with the cube root of
their tokens. A text is split twice: once to count, and once, when the classes are known, into
codes of four bytes a token; training and scoring read only those. Counts of frequent words
are on every executor, others are joined by word, each document's repeats taken together: that is a
matter of transport, and a word's probability doesn't depend on it. Weights are trained in rounds:
every task takes gradient steps on its documents of the round, and the steps of all tasks are
averaged, weighted by tokens, block by block of the weight table.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, settle, strings

#: The end of a text as a token; no word holds white space.
END = "\n"
#: Words whose counts are on every executor.
HEAD = 131_072
CLASSES = 32
SLOTS = 32
#: Classes whose slots are words of their own; the others are for endings.
OWN_CLASSES = 16
#: Groups of texts, by their commonest words; classes keep words of one group together.
GROUPS = 8
#: A code holds class, slot and this many bits of the word's checksum.
HASH_BITS = 21
ROUNDS = 2
BLOCKS = 32
BATCH = 4_096
RATE = 0.35
#: Weighs against large first steps of features that are rare.
CAUTION = 4.0
BLOCK_BYTES = 4_000_000


def held_out(doc_id: Column) -> Column:
    """Documents that the model doesn't learn from: crc32 of the identifier as text mod 7 is 2; a null one reads as empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


# ---------------------------------------------------------------- counts


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of several texts, the place of each token among them, and the number of each text's words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = split.flatten().dictionary_encode()
    codes, offsets = coded.indices.to_numpy(), split.offsets.to_numpy()
    real = np.ones(len(codes), bool)
    blank = pc.index(coded.dictionary, "").as_py()  # what stands ahead of leading white space
    if blank >= 0:
        real = codes != blank
    upto = np.append(0, np.cumsum(real))[offsets]
    return coded.dictionary, codes[real], np.diff(upto)


def checksums(words: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words))


def count_words(train: DataFrame) -> DataFrame:
    """``word``, ``c`` and ``g0``.. : counts over all training texts, by group of the text's commonest word.

    Every task adds up its own words before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(0), BLOCK_BYTES):
                words, codes, n = split_words(batch.column(0).slice(a, b - a))
                text, size = np.repeat(np.arange(b - a), n), max(1, len(words))
                sums = checksums(strings(words))
                pair, times = np.unique(text * size + codes, return_counts=True)
                most = np.zeros(b - a, np.int64)  # the commonest word of each text; of equals, that of the largest checksum
                np.maximum.at(most, pair // size, (times << 32) + (sums[pair % size] if len(pair) else 0))
                group = (most & 0xFFFFFFFF) % GROUPS
                table = np.bincount(codes * GROUPS + group[text], minlength=size * GROUPS)
                at = np.flatnonzero(table)
                ends = np.bincount(group, minlength=GROUPS)
                has = np.flatnonzero(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([words.take(pa.array(at // GROUPS)).cast(pa.string()), pa.array([END] * len(has), pa.string())]), pa.array(np.append(at % GROUPS, has).astype(np.int32)), pa.array(np.append(table[at], ends[has]).astype(np.int64))],
                    names=["word", "grp", "n"],
                )

    n = train.select("text").mapInArrow(run, "word string, grp int, n long")
    return n.groupBy("word").agg(F.sum("n").alias("c"), *[F.sum(F.when(F.col("grp") == g, F.col("n")).otherwise(0)).alias(f"g{g}") for g in range(GROUPS)])


def _least_count(counts: DataFrame, head: int) -> int:
    """The least count at which at most ``head`` words are left, from a histogram of some thousand bins.

    So the driver gets ``head`` rows at most, and words of equal counts are in or out together.
    """
    small = 1 << 12
    fine = F.when(F.col("c") < small, F.col("c")).otherwise(small + F.floor((F.log2("c") - 12) * 64))
    bins = counts.groupBy(fine.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.col("b").desc()).collect()
    least, n = (1 << 62), 0
    for b in bins:
        n += b["n"]
        if n > head:
            break
        least = b["c"]
    return least


@dataclass
class Vocabulary:
    """What the passes share: places and log10 (c + 1) of head words, classes and slots, and the mass of each slot."""

    words: dict[str, int]
    log_count: np.ndarray
    own: dict[str, int]  # a word with a slot of its own: class and slot as one number
    of_ending: np.ndarray  # class of a word by its last two bytes
    mass: np.ndarray  # (CLASSES, SLOTS)
    total: int
    distinct: int

    @property
    def log_all(self) -> float:
        return math.log10(self.total + self.distinct + 1)

    def codes(self, words: list[str], sums: np.ndarray) -> np.ndarray:
        """Class, slot and a part of the checksum of each word, as one number below 2^31."""
        ends = np.fromiter((int.from_bytes(w.encode()[-2:], "big") for w in words), np.int64, len(words))
        at = self.of_ending[ends].astype(np.int64) * SLOTS + sums % SLOTS
        own = np.fromiter((self.own.get(w, -1) for w in words), np.int64, len(words))
        return np.where(own >= 0, own, at) << HASH_BITS | sums & ((1 << HASH_BITS) - 1)


def _bands(group: np.ndarray, mass: np.ndarray, bands: int) -> np.ndarray:
    """Neighbours by group, then falling mass, in bands of about equal (root) mass."""
    order = np.lexsort((-mass, group))
    upto = np.cumsum(np.sqrt(mass[order]))
    out = np.zeros(len(mass), np.int64)
    if len(mass):
        out[order] = np.minimum((upto - 1e-9) / upto[-1] * bands, bands - 1).astype(np.int64)
    return out


def build_vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    """Classes and masses from the counts of all words.

    The driver gets ``head`` words at most, one row for each ending (two bytes: 65,536 at most) and one for each slot.
    """
    groups = [f"g{g}" for g in range(GROUPS)]
    all_of = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    rows = counts.filter(F.col("c") >= _least_count(counts, max(head, OWN_CLASSES * SLOTS))).orderBy(F.col("c").desc(), "word").collect()
    c = np.array([r["c"] for r in rows], np.float64)
    mine = rows[: OWN_CLASSES * SLOTS]
    group = np.array([np.argmax([r[g] for g in groups]) for r in mine], np.int64)
    own = {mine[i]["word"]: k for k, i in enumerate(np.lexsort((np.arange(len(mine)), group)).tolist())}

    raw = F.col("word").cast("binary")
    ending = F.conv(F.hex(F.substring(raw, -2, 2)), 16, 10).cast("int")
    ends = counts.groupBy(ending.alias("e")).agg(*[F.sum(g).alias(g) for g in groups]).collect()
    by_group = np.array([[r[g] for g in groups] for r in ends], np.float64).reshape(-1, GROUPS)
    shared = CLASSES - OWN_CLASSES
    of_ending = (OWN_CLASSES + (np.arange(1 << 16) * 40_503 >> 7) % shared).astype(np.int8)  # of endings that no word has
    if len(ends):
        of_ending[[r["e"] for r in ends]] = OWN_CLASSES + _bands(by_group.argmax(axis=1), by_group.sum(axis=1), shared)

    spark = counts.sparkSession
    table = spark.createDataFrame([(r["e"], int(of_ending[r["e"]])) for r in ends], "e int, class int")
    slot = F.pmod(F.crc32(raw), F.lit(SLOTS)).cast("int")
    sums = counts.select(ending.alias("e"), slot.alias("slot"), "c").join(F.broadcast(table), "e").groupBy("class", "slot").agg(F.sum(F.col("c") + 1).alias("m")).collect()
    mass = np.zeros((CLASSES, SLOTS))
    for r in sums:
        mass[r["class"], r["slot"]] = r["m"]
    for r in mine:
        raw_word = r["word"].encode()
        mass[of_ending[int.from_bytes(raw_word[-2:], "big")], zlib.crc32(raw_word) % SLOTS] -= r["c"] + 1
        mass[divmod(own[r["word"]], SLOTS)] += r["c"] + 1
    mass[OWN_CLASSES:] += 1  # for words that no training text has
    return Vocabulary({r["word"]: i for i, r in enumerate(rows)}, np.log10(c + 1), own, of_ending, mass, int(all_of["n"]), int(all_of["v"]))


# ---------------------------------------------------------------- features and gradients


def feature_rows(train_tokens: int) -> int:
    """Rows of the weight table: a power of two near 16 times the cube root of the training tokens, 4,096 at least."""
    return 1 << max(12, round(math.log2(16 * max(1, train_tokens) ** (1 / 3))))


def features(codes: np.ndarray, first: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the class's three features and of the slot's one, (features, tokens); ``first`` marks where a text begins.

    Ahead of a text's first word there is an empty word.
    """
    n = len(codes)
    age = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    h = (codes & ((1 << HASH_BITS) - 1)).astype(np.uint64)

    def back(k: int) -> np.ndarray:
        out = np.full(n, 0x9E3779B9, np.uint64)
        out[k:] = h[:-k] if n > k else out[k:]
        out[age < k] = 0x9E3779B9
        return out

    one, two = back(1), back(2)
    shift = np.uint64(64 - (n_rows.bit_length() - 1))
    mix = np.uint64(0x9E3779B97F4A7C15)

    def row(x: np.ndarray, kind: int) -> np.ndarray:
        x = (x + np.uint64(kind * 0x51ED27 + 1)) * mix
        return ((x ^ (x >> np.uint64(29))) * mix >> shift).astype(np.int64)

    of_class = (codes >> (HASH_BITS + 5)).astype(np.uint64) << np.uint64(45)
    return np.stack([row(one, 1), row(one * np.uint64(0x1F35) ^ two << np.uint64(23), 2), row(two, 3)]), row(one ^ of_class, 4)[None]


def targets(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = codes >> HASH_BITS
    return at // SLOTS, at % SLOTS


@dataclass
class Model:
    """Weights of classes (rows, CLASSES) and of slots (rows, SLOTS), and what they add to: the logarithms of the masses' shares."""

    of_class: np.ndarray
    of_slot: np.ndarray
    class_bias: np.ndarray
    slot_bias: np.ndarray

    @classmethod
    def fresh(cls, v: Vocabulary) -> Model:
        n, mass = feature_rows(v.total), v.mass + 1e-9
        by_class = mass.sum(axis=1, keepdims=True)
        return cls(np.zeros((n, CLASSES), np.float32), np.zeros((n, SLOTS), np.float32), np.log(by_class[:, 0] / by_class.sum()).astype(np.float32), np.log(mass / by_class).astype(np.float32))

    def classes(self, f: np.ndarray) -> np.ndarray:
        """Unnormalised log probabilities of all classes, (tokens, CLASSES)."""
        return _sums(self.of_class, f, self.class_bias)

    def slots(self, g: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Unnormalised log probabilities of all slots of each token's class, (tokens, SLOTS)."""
        return _sums(self.of_slot, g, np.take(self.slot_bias, classes, axis=0))

    def step(self, f: np.ndarray, g: np.ndarray, classes: np.ndarray, slots: np.ndarray, squares: np.ndarray) -> None:
        """One gradient step on a batch, scaled for each row and softmax by the gradients seen so far."""
        for weights, rows, z, target, seen in ((self.of_class, f, self.classes(f), classes, squares[0]), (self.of_slot, g, self.slots(g, classes), slots, squares[1])):
            np.exp(z, out=z)
            z *= (1 / _total(z))[:, None]
            z[np.arange(len(target)), target] -= 1
            flat, many, n = rows.ravel(), len(rows), len(weights)
            total = np.empty((z.shape[1], n), np.float32)
            for i, x in enumerate(np.ascontiguousarray(z.T, np.float64)):
                total[i] = np.bincount(flat, np.concatenate([x] * many) if many > 1 else x, n)
            seen += np.einsum("ij,ij->j", total, total) / len(total)
            total *= RATE / (CAUTION + np.sqrt(seen))
            weights -= total.T

    def log10(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability of each token's class and slot."""
        f, g = features(codes, first, len(self.of_class))
        classes, slots = targets(codes)
        out = np.empty(len(codes))
        for b in range(0, len(codes), BATCH):
            part = slice(b, b + BATCH)
            at = np.arange(len(classes[part]))
            for k, (z, target) in enumerate(((self.classes(f[:, part]), classes[part]), (self.slots(g[:, part], classes[part]), slots[part]))):
                mine = z[at, target] - np.log(_total(np.exp(z, out=z)))
                out[part] = mine if k == 0 else out[part] + mine
        return out / math.log(10)


def _sums(weights: np.ndarray, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = np.take(weights, rows[0], axis=0)
    for r in rows[1:]:
        out += np.take(weights, r, axis=0)
    out += bias
    return np.minimum(out, 60, out=out)  # far above any sum of trained weights; keeps exponentials finite


def _total(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)


def code_blocks(column: pa.Array, tokens: int = 200_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of rows with their codes, where texts begin, and the numbers of tokens."""
    for a, b in blocks(column, 4 * tokens):
        raw = [x.as_buffer() for x in column.slice(a, b - a)]
        n = np.array([len(x) // 4 for x in raw])
        codes = np.concatenate([np.frombuffer(x, "<u4") for x in raw]).astype(np.int64)
        first = np.zeros(len(codes), bool)
        first[np.cumsum(n) - n] = True
        yield a, b, codes, first, n


def train(coded: DataFrame, model: Model, rounds: int = ROUNDS) -> None:
    """Train ``model`` in place on ``coded`` (``row``, ``held_out``, ``codes``); each training document takes part in one round."""
    spark = coded.sparkSession
    n_rows = len(model.of_class)
    rows_a_block = -(-n_rows // BLOCKS)
    width = CLASSES + SLOTS
    for r in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            old = now.value
            mine, squares, n = Model(old.of_class.copy(), old.of_slot.copy(), old.class_bias, old.slot_bias), np.zeros((2, n_rows), np.float32), 0
            batch_size = max(2 * BATCH, n_rows)
            for batch in batches:
                for _, _, codes, first, _ in code_blocks(batch.column(0)):
                    f, g = features(codes, first, n_rows)
                    classes, slots = targets(codes)
                    for at in range(0, len(codes), batch_size):
                        part = slice(at, at + batch_size)
                        mine.step(f[:, part], g[:, part], classes[part], slots[part], squares)
                    n += len(codes)
            if n:
                delta = np.concatenate([mine.of_class - old.of_class, mine.of_slot - old.of_slot], axis=1).astype("<f4")
                parts = [delta[b * rows_a_block : (b + 1) * rows_a_block].tobytes() for b in range(BLOCKS)]
                context = TaskContext.get()
                slot = (context.partitionId() if context else 0) % 64
                yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([slot] * BLOCKS, pa.int32()), pa.array([n] * BLOCKS, pa.int64()), pa.array(parts, pa.binary())], names=["block", "slot", "n", "delta"])

        def mean(frame: pd.DataFrame) -> pd.DataFrame:
            n = frame["n"].sum()
            total = sum(np.frombuffer(d, "<f4").astype(np.float64) * k for d, k in zip(frame["delta"], frame["n"], strict=True)) / n
            return pd.DataFrame({"block": frame["block"][:1], "slot": frame["slot"][:1], "n": [n], "delta": [total.astype("<f4").tobytes()]})

        schema = "block int, slot int, n long, delta binary"
        mine = coded.filter(~F.col("held_out") & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == r))
        deltas = mine.select("codes").mapInArrow(run, schema).groupBy("block", "slot").applyInPandas(mean, schema)
        for x in deltas.groupBy("block").applyInPandas(mean, schema).collect():
            d = np.frombuffer(x["delta"], "<f4").reshape(-1, width)
            at = slice(x["block"] * rows_a_block, x["block"] * rows_a_block + len(d))
            model.of_class[at] += d[:, :CLASSES]
            model.of_slot[at] += d[:, CLASSES:]
        now.unpersist()


# ---------------------------------------------------------------- scores

CODED = "held_out boolean, row long, n_tokens long, n_head long, head_log double, rest array<struct<word:string,tf:bigint>>, codes binary"


def encode(docs: DataFrame, vocabulary, kind: str) -> DataFrame:
    """Every text as codes, the sum of its head words' log10 (c + 1), and its other words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        end_code, end_at = int(v.codes([END], checksums([END]))[0]), v.words.get(END, -1)
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 33
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK_BYTES):
                m = b - a
                words, codes, n = split_words(batch.column(1).slice(a, m))
                names, size = strings(words), max(1, len(words))
                of_word, head = v.codes(names, checksums(names)), np.fromiter((v.words.get(w, -1) for w in names), np.int64, len(names))
                ends = np.cumsum(n + 1)
                whole = np.empty(int(ends[-1]), np.int64)  # each text's words and its end
                inner = np.ones(len(whole), bool)
                inner[ends - 1] = False
                whole[inner], whole[ends - 1] = of_word[codes], end_code
                place = np.full(len(whole), end_at, np.int64)
                place[inner] = head[codes]
                known = place >= 0
                logs = np.where(known, np.append(v.log_count, 0.0)[place], 0.0)
                begin = ends - n - 1
                text = np.repeat(np.arange(m), n)
                tail = head[codes] < 0
                pair, tf = np.unique(text[tail] * size + codes[tail], return_counts=True)
                rest = [words.take(pa.array(pair % size)).cast(pa.string()), pa.array(tf, pa.int64())]
                upto = np.searchsorted(pair, np.arange(m + 1) * size).astype(np.int32)
                raw = memoryview(whole.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, m), batch.column(2).slice(a, m), pa.array(np.arange(row, row + m)), pa.array((n + 1).astype(np.int64)),
                        pa.array(np.add.reduceat(known, begin, dtype=np.int64)), pa.array(np.add.reduceat(logs, begin)),
                        pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays(rest, names=["word", "tf"])),
                        pa.array([raw[4 * i : 4 * j] for i, j in zip(begin.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["_id", *(x.split()[0] for x in CODED.split(", "))],
                )
                row += m

    return docs.select("_id", "text", "held_out").mapInArrow(run, f"_id {kind}, {CODED}")


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Score every row of ``df`` by a model trained on those that aren't held out.

    Returns ``<id_col>``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``
    (log10 probabilities of the whole text and its end). A null text is empty: its one token is
    the end. Repeated rows are scored alike. Without training rows every token has probability 1.
    An empty table gives an empty table. Other columns don't matter. A text of any length is scored whole.
    """
    docs = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), held_out(F.col(id_col)).alias("held_out"))
    counts = settle(count_words(docs.filter(~F.col("held_out"))), "word_counts")
    v = build_vocabulary(counts, head)
    context = df.sparkSession.sparkContext
    kind = df.schema[id_col].dataType.simpleString()
    coded = settle(encode(docs, context.broadcast(v), kind), "codes")
    model = Model.fresh(v)
    if v.total:
        train(coded, model)
    shared, log_mass = context.broadcast(model), np.log10(v.mass + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b, codes, first, n in code_blocks(batch.column(batch.num_columns - 1)):
                logs = model.log10(codes, first) - log_mass[targets(codes)]
                sums = np.add.reduceat(logs, np.cumsum(n) - n)
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(6)), pa.array(sums.astype(float))], names=[*batch.schema.names[:6], "model"])

    slim = ["_id", *(x.split()[0] for x in CODED.split(", ")[:5])]
    scored = coded.select(*slim, "codes").mapInArrow(run, f"_id {kind}, " + ", ".join(CODED.split(", ")[:5]) + ", model double")
    # Counts of the other words: unknown ones have none, and log10(0 + 1) is 0.
    others = coded.select("row", F.explode("rest").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.tf").alias("tf"))
    found = others.join(counts.select("word", "c"), "word").groupBy("row").agg(F.sum("tf").alias("known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more"))
    logs = F.col("head_log") + F.coalesce("more", F.lit(0.0))
    base = logs - F.col("n_tokens") * F.lit(v.log_all)
    return scored.join(found, "row", "left").select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", (F.col("n_head") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + logs if v.total else base).alias("score"),
    )
