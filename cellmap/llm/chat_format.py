"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole and encoded once, with offsets. The turns' content spans
and the tokens' spans are both sorted; a binary search gives the tokens of every assistant
span. Turn markers are tokens of their own, so no token lies across a border.

    <|im_start|>role<|im_sep|>text<|im_end|>

Control strings inside roles and texts are escaped: a backslash goes in behind their first
character, one more where backslashes are there already, so that this can be undone.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Control strings of common chat templates, escaped wherever a text has them.
CONTROLS = [START, SEPARATOR, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]

_REST = "|".join(re.escape(c[1:]) for c in CONTROLS)
_BARE = re.compile(rf"([<\[])(?=\\*(?:{_REST}))")
_ESCAPED = re.compile(rf"([<\[])\\(?=\\*(?:{_REST}))")


def escape(text: str) -> str:
    return _BARE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, str]]]:
    """The whole conversation, and the span and role of every turn's content."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read(formatted: str) -> list[tuple[str, str]]:
    """Turns back from a rendered conversation."""
    turns = []
    for turn in formatted.split(START)[1:]:
        role, body = turn.split(SEPARATOR)
        turns.append((unescape(role), unescape(body.removesuffix(END))))
    return turns


def loss_mask(starts: list[int], ends: list[int], spans: list[tuple[int, int, str]], role: str = "assistant") -> list[bool]:
    """Which tokens lie in a span of ``role``; tokens and spans are in order of place."""
    mask = [False] * len(starts)
    for a, b, who in spans:
        if who == role and a < b:
            i, j = bisect.bisect_right(ends, a), bisect.bisect_left(starts, b)
            if starts[i] < a or ends[j - 1] > b:
                raise ValueError("a token lies across a border")
            mask[i:j] = [True] * (j - i)
    return mask


def masked_text(formatted: str, starts: list[int], ends: list[int], mask: list[bool]) -> str:
    """The characters under the mask, each once; tokens of one character share its place."""
    out, at = [], 0
    for a, b, m in zip(starts, ends, mask, strict=True):
        if m and b > at:
            out.append(formatted[max(a, at) : b])
            at = b
    return "".join(out)


@functools.lru_cache(maxsize=2)
def chat_tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.add_special_tokens([START, SEPARATOR, END])
    return tokenizer


FORMATTED = "n_turns long, formatted string, ids array<int>, starts array<int>, ends array<int>, mask array<boolean>"
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_conversations(df: DataFrame, path: str, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: ``<id_col>`` and the columns of FORMATTED.

    ``df`` has ``<id_col>, turn, role, text``. Turns are ordered by ``turn`` (null first), equal ones
    by role and text; repeated rows are turns of their own. A null role or text counts as
    empty; a null conversation is one like others. A conversation is one output row, so its
    turns meet in one task; different conversations don't.
    """
    kind = df.schema[id_col].dataType.simpleString()
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = df.groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                done = [render([(t["role"], t["text"]) for t in turns]) for turns in part.column(1).to_pylist()]
                columns: list[list] = [[], [], [], [], [], []]
                for (text, spans), e in zip(done, tokenizer.encode_batch([t for t, _ in done], add_special_tokens=False), strict=True):
                    starts, ends = (list(x) for x in zip(*e.offsets, strict=True)) if e.offsets else ([], [])
                    for c, v in zip(columns, (len(spans), text, e.ids, starts, ends, loss_mask(starts, ends, spans)), strict=True):
                        c.append(v)
                ints = pa.list_(pa.int32())
                types = [pa.int64(), pa.string(), ints, ints, ints, pa.list_(pa.bool_())]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns, types)], names=["_id", "n_turns", "formatted", "ids", "starts", "ends", "mask"])

    return whole.mapInArrow(run, f"_id {kind}, {FORMATTED}").withColumnRenamed("_id", id_col)


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Digests of what the formatted rows say, read back from them: ``<id_col>`` and the columns of DIGESTS."""
    kind = formatted.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for text, starts, ends, mask in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                turns = read(text)
                loss = unescape(masked_text(text, starts, ends, mask))
                row = len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)
                for c, v in zip(columns, row, strict=True):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, types)], names=["_id", *(x.split()[0] for x in DIGESTS.split(", "))])

    return formatted.select(id_col, "formatted", "starts", "ends", "mask").mapInArrow(run, f"_id {kind}, {DIGESTS}").withColumnRenamed("_id", id_col)
