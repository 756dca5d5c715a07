"""Best-fit packing by a grouping genetic algorithm.

Documents are tokenised once; what is longer than a sequence is cut into whole sequences
and a rest. Rests are dealt into groups of some thousand by a hash of their row numbers, and each
group is packed by a grouping genetic algorithm (a gene is a bin, not a document): crossover
injects whole well-filled bins of one parent into the other, removes the documents that they
repeat, and best-fits the displaced ones. The first generation is best fit of random orders, so
what is gained on it is gained by crossover and mutation. Every group has several islands, each a
population of its own in a task of its own; after each epoch the elite of an island
migrates to the next one. Bins that stay poorly filled are opened again and dealt into new
groups, for as long as that closes a fair part of them.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import blocks, n_partitions, settle, strings

GROUP = 4_096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 5
#: A bin with more than this share free is opened again at the next level.
LOOSE = 1 / 64
#: Levels go on while one closes this share of its rows.
CLOSED = 1 / 4
#: Bytes that a worker keeps of words and their ids, and of parts and theirs.
MOST_BYTES = 16_000_000
#: Parts that the library encodes as one text.
PARTS_A_TEXT = 400
#: Texts of a call to the library, whose results take some hundred bytes a token until they are copied.
TEXTS_A_CALL = 64
#: The vocabulary's own splitter; the same parts of a lower-case word of ASCII and the letters U+00C0 to U+00FF; and such words.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PARTS = "('s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+)"
PLAIN = "^[!-~\u00c0-\u00ff]*$"


# ---------------------------------------------------------------- tokens


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and ends of a binary array that isn't a slice."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[: len(values) + 1] if len(values) else np.zeros(1, np.int32)
    data = values.buffers()[2] if len(values) else None
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), ends


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array of such data and ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


class Known:
    """Words and their ids as two Arrow arrays, without a Python object for each.

    They hold at most MOST_BYTES however many words there are and however long; beyond that
    the words of the last call stay, if they fit.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words, self.ids = pa.array([""], pa.string()), pa.array([b""], pa.binary())

    def look_up(self, words: pa.Array, learn: Callable[[pa.Array], pa.Array]) -> pa.Array:
        """The ids of distinct words; ``learn`` works out those of new ones."""
        at = pc.index_in(words, value_set=self.words)
        if not at.null_count:
            return self.ids.take(at)
        new = words.filter(at.is_null())
        all_words, all_ids = pa.concat_arrays([self.words, new]), pa.concat_arrays([self.ids, learn(new)])
        at = at.fill_null(-1).to_numpy().copy()
        at[at < 0] = np.arange(len(self.words), len(all_words))
        ids = all_ids.take(pa.array(at))
        if all_words.nbytes + all_ids.nbytes > MOST_BYTES:
            self.clear()
            all_words, all_ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, ids])
        if all_words.nbytes + all_ids.nbytes <= MOST_BYTES:
            self.words, self.ids = all_words, all_ids
        return ids


class WordIds:
    """Ids of words as little-endian 32-bit numbers, each word worked out once by the library.

    White space never joins words in the vocabularies for which this is used: their normaliser
    and splitter treat what stands between white space alone. A plain word is split into parts
    first, and only parts that are new go to the library, as texts of many parts that are told
    apart by the tokens that end words. Other words go to the library whole. A vocabulary with
    another splitter gets all texts whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallel units
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_words = SPLITTER in str(self.tokenizer.pre_tokenizer)
        self.of_parts = Tokenizer(self.tokenizer.model)
        self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words, self.parts = Known(), Known()

    @staticmethod
    def _library(tokenizer: Tokenizer, texts: list[str]) -> list[bytes]:
        calls = (tokenizer.encode_batch_fast(texts[at : at + TEXTS_A_CALL], add_special_tokens=False) for at in range(0, len(texts), TEXTS_A_CALL))
        return [np.array(e.ids, "<u4").tobytes() for call in calls for e in call]

    def _learn_parts(self, column: pa.Array) -> pa.Array:
        parts = strings(column)
        texts = [" ".join(parts[at : at + PARTS_A_TEXT]) for at in range(0, len(parts), PARTS_A_TEXT)]
        ids = np.frombuffer(b"".join(self._library(self.of_parts, texts)), "<u4")
        ends = np.append(0, 4 * (np.flatnonzero(self.ends_word[ids]) + 1))
        if len(ends) != len(parts) + 1:
            raise ValueError("a part isn't one word of the vocabulary's splitter")
        return _binary(ids.view(np.uint8), ends)

    def _learn(self, column: pa.Array) -> pa.Array:
        plain = pc.and_(pc.match_substring_regex(column, PLAIN), pc.invert(pc.match_substring(column, "<|")))
        rest = pa.array(self._library(self.tokenizer, column.filter(pc.invert(plain)).to_pylist()), pa.binary())
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(column.filter(plain)), PARTS, r"\1 "))
        coded = split.flatten().dictionary_encode()
        data, ends = _bytes(self.parts.look_up(coded.dictionary, self._learn_parts).take(coded.indices))
        both = pa.concat_arrays([_binary(data, ends[split.offsets.to_numpy()]), rest])
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")  # plain words first, as in ``both``
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        return both.take(pa.array(at))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin and end. A null text is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_words:
            ids = self._library(self.tokenizer, texts.to_pylist())
            return np.frombuffer(b"".join(ids), "<u4"), np.cumsum([0, *(len(x) // 4 for x in ids)])
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        data, ends = _bytes(self.words.look_up(coded.dictionary, self._learn).take(coded.indices))
        return data.view("<u4"), ends[split.offsets.to_numpy()] // 4


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


PIECE = "piece int, start long, length long, ids_crc32 long"


def pieces(df: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int, block_bytes: int = 6_000_000) -> DataFrame:
    """Cut every document's ids (and ``end_id``) into pieces of at most ``capacity``; a null text counts as empty."""
    kind = df.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        for batch in batches:
            for a, b in blocks(batch.column(1), block_bytes):
                ids, cuts = known.encode(batch.column(1).slice(a, b - a))
                raw, cuts, rows = memoryview(ids.tobytes()), (4 * cuts.astype(np.int64)).tolist(), []
                for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    whole = raw[lo:hi].tobytes() + end
                    for p, at in enumerate(range(0, len(whole), 4 * capacity)):
                        part = whole[at : at + 4 * capacity]
                        rows.append((i, p, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(r, pa.int64()) for r in columns[2:])],
                    names=["_id", "piece", "start", "length", "ids_crc32"],
                )

    return df.select(id_col, text_col).mapInArrow(run, f"_id {kind}, {PIECE}")


# ---------------------------------------------------------------- the algorithm for one group

Bins = list[list[int]]


def best_fit(items: list[int], lengths: list[int], capacity: int, bins: Bins) -> Bins:
    """Put items, in the order given, where the least space remains; open bins where none fits."""
    space: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit s is set if a bin has s left
    for b, members in enumerate(bins):
        s = capacity - sum(lengths[i] for i in members)
        space[s].append(b)
        free |= 1 << s
    for i in items:
        n = lengths[i]
        fits = free >> n
        if fits:
            s = n + (fits & -fits).bit_length() - 1
            b = space[s].pop()
            if not space[s]:
                free ^= 1 << s
            bins[b].append(i)
        else:
            s, b = capacity, len(bins)
            bins.append([i])
        space[s - n].append(b)
        free |= 1 << (s - n)
    return bins


def plain_best_fit(lengths: list[int], capacity: int) -> Bins:
    """Best fit of decreasing lengths: what the algorithm is measured against; no packing starts from it."""
    return best_fit(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, capacity, [])


def fills(bins: Bins, lengths: list[int]) -> list[int]:
    return [sum(map(lengths.__getitem__, b)) for b in bins]


def fitness(bins: Bins, lengths: list[int], capacity: int) -> float:
    """Falkenauer's measure: the mean squared filling."""
    return sum((n / capacity) ** 2 for n in fills(bins, lengths)) / max(1, len(bins))


def crossover(mother: Bins, father: Bins, lengths: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Inject some of the father's well-filled bins into the mother."""
    full = np.array(fills(father, lengths))
    good = np.argsort(-full, kind="stable")[: max(1, len(father) // 2)]
    chosen = [father[k] for k in good[rng.random(len(good)) < 0.5]] or [father[int(good[0])]]
    taken = {i for b in chosen for i in b}
    child, displaced = [list(b) for b in chosen], []
    for b in mother:
        if taken.isdisjoint(b):
            child.append(list(b))
        else:
            displaced += [i for i in b if i not in taken]
    displaced.sort(key=lambda i: (-lengths[i], i))
    return best_fit(displaced, lengths, capacity, child)


def mutate(bins: Bins, lengths: list[int], capacity: int, rng: np.random.Generator) -> Bins:
    """Empty the worst bins and a few others, and best-fit what they held."""
    order = np.argsort(fills(bins, lengths), kind="stable").tolist()
    out = {*order[: max(1, len(bins) // 20)], *rng.integers(0, len(bins), max(1, len(bins) // 20)).tolist()}
    items = sorted((i for b in out for i in bins[b]), key=lambda i: (-lengths[i], i))
    return best_fit(items, lengths, capacity, [list(b) for k, b in enumerate(bins) if k not in out])


def start(lengths: list[int], capacity: int, n: int, rng: np.random.Generator) -> list[Bins]:
    """Best fit of random orders."""
    return [best_fit(rng.permutation(len(lengths)).tolist(), lengths, capacity, []) for _ in range(n)]


def evolve(population: list[Bins], lengths: list[int], capacity: int, generations: int, rng: np.random.Generator, done: dict | None = None) -> list[Bins]:
    """The population after some generations, best first. It stops early where no packing can have fewer bins.

    ``done`` counts the crossovers made.
    """
    least = -(-sum(lengths) // capacity)
    ranked = sorted(((len(b), -fitness(b, lengths, capacity), k, b) for k, b in enumerate(population)), key=lambda x: x[:3])
    born = len(ranked)
    for _ in range(generations):
        if ranked[0][0] <= least:
            break
        mother, father = ranked[0][3], ranked[int(rng.integers(1, len(ranked)))][3] if len(ranked) > 1 else ranked[0][3]
        young = [crossover(mother, father, lengths, capacity, rng), crossover(father, mother, lengths, capacity, rng)]
        young.append(mutate(young[0], lengths, capacity, rng))
        if done is not None:
            done["crossovers"] = done.get("crossovers", 0) + 2
        size = len(ranked)
        ranked = sorted([*ranked, *((len(b), -fitness(b, lengths, capacity), born + k, b) for k, b in enumerate(young))], key=lambda x: x[:3])[:size]
        born += len(young)
    return [x[3] for x in ranked]


# ---------------------------------------------------------------- the distributed part


def _flat(bins: Bins, n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _bins(flat: bytes) -> Bins:
    of = np.frombuffer(flat, "<i4")
    bins: Bins = [[] for _ in range(int(of.max()) + 1)] if len(of) else []
    for i, k in enumerate(of.tolist()):
        bins[k].append(i)
    return bins


STATE = "grp long, island int, lengths array<int>, elite binary"


def _epoch(capacity: int, epoch: int, migrate: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                lengths = [int(x) for x in r.lengths]
                rng = np.random.default_rng([int(r.grp) & 0xFFFFFFFF, int(r.island), epoch])
                first = [_bins(x) for x in r.elite if x]
                best = evolve([*first, *start(lengths, capacity, POPULATION - len(first), rng)], lengths, capacity, GENERATIONS, rng)[0]
                flat = _flat(best, len(lengths))
                out.append((r.grp, r.island, r.lengths, flat))
                if migrate:
                    out.append((r.grp, (r.island + 1) % ISLANDS, r.lengths, flat))
            yield pd.DataFrame(out, columns=["grp", "island", "lengths", "elite"])

    return run


def _place(capacity: int, schema_of: list[str]):
    """Rows of each group with their bins, offsets and the room that their bins leave."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                rows = pd.DataFrame([tuple(x[k] for k in schema_of) for x in r.members], columns=schema_of)
                elites = [_bins(x) for x in r.elite]
                length = rows["length"].tolist()
                best = min(elites, key=lambda b: (len(b), -fitness(b, length, capacity)))
                at, offset, bin_of, free = 0, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                for k, b in enumerate(best):
                    at = 0
                    for i in b:
                        offset[i], bin_of[i] = at, k
                        at += length[i]
                    free[b] = capacity - at
                yield rows.assign(grp=r.grp, bin=bin_of, offset=offset, free=free)

    return run


def pack_rests(rests: DataFrame, capacity: int) -> DataFrame:
    """Pack rows with ``_id``, the columns of PIECE and ``_row`` (a number of its own for each row); adds ``sequence_id`` and ``offset``.

    Groups are dealt by a hash of ``_row``, so that equal rows spread like others and no group grows with the table.
    A sequence's number holds level, group and bin side by side: a group has fewer than 2^31 rows as they are one array.
    """
    columns = rests.columns
    kinds = {f.name: f.dataType.simpleString() for f in rests.schema}
    done, todo, level, n = None, rests, 0, rests.count()
    while True:
        groups = max(1, -(-n // GROUP))
        grouped = settle(
            todo.withColumn("grp", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(groups)))
            .groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("length", *[c for c in columns if c != "length"]))).alias("members")),
            f"groups_{level}",
        )
        lengths = grouped.select("grp", F.col("members.length").cast("array<int>").alias("lengths"))
        tasks = min(groups * ISLANDS, 8 * n_partitions(rests.sparkSession))
        state = lengths.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).withColumn("elite", F.array().cast("array<binary>"))
        for epoch in range(EPOCHS):
            state = state.repartition(tasks, "grp", "island").mapInPandas(_epoch(capacity, epoch, migrate=epoch + 1 < EPOCHS), STATE)
            if epoch + 1 < EPOCHS:
                state = state.groupBy("grp", "island").agg(F.first("lengths").alias("lengths"), F.collect_list("elite").alias("elite"))
        solved = grouped.join(state.groupBy("grp").agg(F.collect_list("elite").alias("elite")), "grp")
        schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", grp long, bin long, offset long, free long"
        placed = settle(solved.mapInPandas(_place(capacity, columns), schema), f"packed_{level}")
        loose = F.col("free") > capacity * LOOSE
        left = 0 if groups == 1 else placed.filter(loose).count()
        last = left == 0 or n - left < n * CLOSED
        named = placed.withColumn("sequence_id", F.lit(level).cast("long") * F.lit(1 << 58) + F.col("grp") * F.lit(1 << 31) + F.col("bin"))
        kept = named if last else named.filter(~loose)
        kept = kept.select(*columns, "sequence_id", "offset")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done
        todo, n, level = placed.filter(loose).select(*columns), left, level + 1


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents of ``df`` into sequences of at most ``capacity`` tokens.

    Returns one row per piece: ``<id_col>``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset``. A null or empty text is its end id alone. Repeated rows
    are documents of their own. An empty table gives an empty table. ``path`` must be readable on
    every executor.
    """
    cut = settle(pieces(df, path, id_col, text_col, capacity, end_id).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    whole = cut.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("_row")).withColumn("offset", F.lit(0).cast("long"))
    packed = whole.unionByName(pack_rests(cut.filter(F.col("length") < capacity), capacity)).drop("_row")
    return packed.withColumnRenamed("_id", id_col)
