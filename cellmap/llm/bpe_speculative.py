"""Byte-level BPE by speculation and verification.

A greedy longest match proposes tokens for every new word. A proposal is the exact encoding
if each token is one that merging can reach and no merge would ever cross the border of two
neighbours; both are checked for all proposals of a block at once, in numpy. Only words
that fail are merged exactly. Words repeat, so each Python worker keeps those it has seen.

Ids must follow the order of merges (base symbols first), as in the public 50k vocabularies;
this is verified on loading.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.pre_tokenizers import ByteLevel

#: Words that a worker keeps; beyond that it starts anew.
MOST_WORDS = 600_000
#: Characters that are worked on together.
BLOCK_CHARS = 1_000_000
#: Words of at most so many bytes are merged by scanning, longer ones by a heap.
SHORT = 48

#: White space as the vocabulary's word pattern has it (the Unicode property), and that pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A run of other characters with the blank ahead of it, or white space; word borders never lie elsewhere than within or between these.
RUNS = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WORDS = regex.compile(WORD)
#: Characters whose classes no Unicode version has changed; others go to the library's own splitter.
PLAIN = regex.compile(r"[\x00-\u024f]*")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it is printable, else the next free code point from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in letter)
    return [c for _, c in sorted({**letter, **{b: chr(256 + i) for i, b in enumerate(rest)}}.items())]


class SpeculativeBpe:
    """Encoder and decoder for one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        of_letter = {c: bytes([b]) for b, c in enumerate(letters)}
        n = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * n
        for token, i in vocab.items():
            self.bytes_of[i] = b"".join(of_letter[c] for c in token)
        self.id_of = {self.bytes_of[i]: i for i in vocab.values()}
        self.longest = max(map(len, self.id_of))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        whole = np.array([vocab[a + b] for a, b in pairs], np.int64)
        if (np.diff(whole) <= 0).any() or (whole <= np.maximum(left, right)).any():
            raise ValueError("ids don't follow the order of merges")
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.left[whole], self.right[whole] = left, right
        order = np.argsort(left << 32 | right)
        self.pair_keys, self.pair_ids = (left << 32 | right)[order], whole[order]
        self.merged = dict(zip((left << 32 | right).tolist(), whole.tolist(), strict=True))
        #: Whether merging the token's own bytes gives the token.
        self.reachable = np.ones(n, bool)
        self.reachable[whole] = self._apart(left, right, skip_first=True)
        for t, a, b in zip(whole.tolist(), left.tolist(), right.tolist(), strict=True):
            self.reachable[t] &= self.reachable[a] and self.reachable[b]
        self.splitter = ByteLevel(add_prefix_space=False, use_regex=True)
        self.to_bytes = {ord(c): b for b, c in enumerate(letters)}
        self.seen: dict[str, bytes] = {}
        self.known: dict[bytes, bytes] = {}

    def _merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that a and b merge to, or a number above all."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], 1 << 40)

    def _apart(self, a: np.ndarray, b: np.ndarray, skip_first: bool = False) -> np.ndarray:
        """Whether no merge crosses the border of tokens a and b.

        Going back in time, the newer of the two tokens at the border is undone. Symbols x and
        y at the border merge if their merge comes before either is used up: earlier than x is
        used, and no later than y is (of equal merges the left one comes first).
        """
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_used, y_used = np.full(len(a), 1 << 39), np.full(len(a), 1 << 39)
        first = skip_first
        while len(at):
            if not first:
                m = self._merge(x, y)
                crossed = (m < x_used) & (m <= y_used)
                ok[at[crossed]] = False
            else:
                crossed = np.zeros(len(at), bool)
            first = False
            go = ~crossed & ((self.left[x] >= 0) | (self.left[y] >= 0))
            at, x, y, x_used, y_used = at[go], x[go], y[go], x_used[go], y_used[go]
            undo_x = x > y
            x_used, y_used = np.where(undo_x, x, x_used), np.where(undo_x, y_used, y)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
        return ok

    def _greedy(self, word: bytes) -> list[int]:
        id_of, n = self.id_of, len(word)
        if (t := id_of.get(word)) is not None:
            return [t]
        out, at = [], 0
        while at < n:
            end = min(n, at + self.longest)
            while (t := id_of.get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def _exact(self, word: bytes) -> list[int]:
        """Merge by rank, of equal ranks the leftmost first."""
        ids = [self.id_of[word[i : i + 1]] for i in range(len(word))]
        return self._exact_short(ids) if len(ids) <= SHORT else self._exact_long(ids)

    def _exact_short(self, ids: list[int]) -> list[int]:
        merged, none = self.merged.get, 1 << 40
        whole = [merged(a << 32 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while whole and (m := min(whole)) < none:
            i = whole.index(m)
            ids[i : i + 2] = [m]
            del whole[i]
            if i < len(whole):
                whole[i] = merged(m << 32 | ids[i + 1], none)
            if i:
                whole[i - 1] = merged(ids[i - 1] << 32 | m, none)
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        after, before, n = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), len(ids)
        heap = [(m, i) for i in range(n - 1) if (m := self.merged.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or self.merged.get(ids[i] << 32 | ids[j]) != m:
                continue
            ids[i], ids[j] = m, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := self.merged.get(m << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (p, i))
            if (h := before[i]) >= 0 and (p := self.merged.get(ids[h] << 32 | m)) is not None:
                heapq.heappush(heap, (p, h))
        return [t for t in ids if t >= 0]

    def words(self, run: str) -> list[bytes]:
        if PLAIN.fullmatch(run):
            return [w.encode() for w in WORDS.findall(run)]
        return [bytes(map(self.to_bytes.__getitem__, map(ord, w))) for w, _ in self.splitter.pre_tokenize_str(run)]

    def learn(self, runs: list[str]) -> None:
        """Encode runs that haven't been seen: propose, verify, repair."""
        split = [self.words(r) for r in runs]
        known = self.known
        words = [*{w for ws in split for w in ws if w not in known}]
        ids = [self._greedy(w) for w in words]
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64)
        if len(flat):
            ends = np.cumsum([len(x) for x in ids])
            starts = np.append(0, ends[:-1])
            good = self.reachable[flat]
            inner = np.ones(len(flat), bool)
            inner[starts] = False  # the others have a neighbour to the left in their word
            right = np.flatnonzero(inner)
            good[right] &= self._apart(flat[right - 1], flat[right])
            fine = np.logical_and.reduceat(good, starts)
            raw = flat.astype("<u4").tobytes()
            for w, a, b, f in zip(words, (4 * starts).tolist(), (4 * ends).tolist(), fine.tolist(), strict=True):
                known[w] = raw[a:b] if f else np.array(self._exact(w), "<u4").tobytes()
        find = known.__getitem__
        for r, ws in zip(runs, split, strict=True):
            self.seen[r] = find(ws[0]) if len(ws) == 1 else b"".join(map(find, ws))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Strings of special tokens in a text are those tokens, as the library has it."""
        parts: list[list[str | int]] = []
        for text in texts:
            row, at = [], 0
            for m in self.at_special.finditer(text) if self.at_special else ():
                row += [text[at : m.start()], self.special[m[0]]]
                at = m.end()
            parts.append([*row, text[at:]])
        split = [[x if isinstance(x, int) else RUNS.findall(x) for x in row] for row in parts]
        if len(self.seen) > MOST_WORDS:
            self.seen.clear()
            self.known.clear()
        seen = self.seen
        if new := {r for row in split for x in row if not isinstance(x, int) for r in x if r not in seen}:
            self.learn(list(new))
        find = seen.__getitem__
        return [np.frombuffer(b"".join(x.to_bytes(4, "little") if isinstance(x, int) else b"".join(map(find, x)) for x in row), "<u4") for row in split]

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> SpeculativeBpe:
    """One coder per vocabulary and Python worker."""
    return SpeculativeBpe(path)


def blocks(texts: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts with the place of the first, about BLOCK_CHARS characters at once; null counts as empty."""
    first, block, chars = 0, [], 0
    for i, text in enumerate(texts):
        block.append(text.as_py() or "")
        chars += len(block[-1])
        if chars >= BLOCK_CHARS:
            yield first, block
            first, block, chars = i + 1, [], 0
    if block:
        yield first, block


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encode and decode every row; one row out per row in, nothing is shuffled.

    Returns ``<id_col>``, ``n_tokens`` and ``ids``, ``decoded``; with ``digests`` their SHA-256
    (of the decimal ids joined by commas, and of the decoded text in UTF-8) in their place.
    A null text counts as empty and has no tokens. ``path`` must be readable on every executor.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = load(path)
        decimal = [str(i).encode() for i in range(len(coder.bytes_of))]
        for batch in batches:
            for first, texts in blocks(batch.column(1)):
                rows = coder.encode(texts)
                listed = [x.tolist() for x in rows]
                decoded = [coder.decode(x) for x in listed]
                n = pa.array([len(x) for x in rows], pa.int64())
                if digests:
                    out = [pa.array([hashlib.sha256(b",".join(map(decimal.__getitem__, x))).hexdigest() for x in listed]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                    names = ["ids_sha256", "decoded_sha256"]
                else:
                    out, names = [pa.array(listed, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), n, *out], names=[id_col, "n_tokens", *names])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, {rest}")
