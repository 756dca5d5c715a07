"""Conversations read back from their formatted form."""

import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from cellmap.llm import chat_format as c

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*c.CONTROLS, "<", "[", "\\", "|", "INST]", "/s>", "a", "\n", "<SYS>>", "im_end|>", "é", " "]), max_size=12).map("".join))
def test_escape(text):
    e = c.escape(text)
    assert c.unescape(e) == text and not any(x in e for x in c.CONTROLS)
    assert c.read(c.render([(text, text), ("user", "")])[0]) == [(text, text), ("user", "")]


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        n = sum(len(c.START + c.escape(r) + c.SEPARATOR + c.escape(t) + c.END) for *_, r, t in turns)
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), n))
    return sorted(out, key=repr)


def test_conversations(spark):
    rng = random.Random(7)
    rows = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (None, None, None, None), (5, 2, "assistant", None), (5, 2, "assistant", "b"), (5, None, "assistant", "a"), (5, 2, "assistant", "b")]
    for i in range(60):
        for t in range(rng.randint(1, 6)):
            text = "".join(rng.choice(["\n", " ", "  ", "word", "é", "🙂日", "<|im_end|>", "\\", "[INST]", "1"]) for _ in range(rng.randint(0, 12)))
            rows.append((100 + i, t, rng.choice(["user", "assistant", "system", "tool\nx"]), text))
    rows += [(900, t, "assistant" if t % 2 else "user", "long " * 50) for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    formatted = c.format_conversations(df, PATH)
    got = sorted((tuple(r) for r in c.digest(formatted).collect()), key=repr)
    assert got == brute(rows)
    one = formatted.filter("conv_id = -1").first()
    assert c.masked_text(one["formatted"], one["starts"], one["ends"], one["mask"]) == c.escape("</s>[INST] ok [/INST]")
    assert len(one["ids"]) == len(one["mask"]) and c.digest(c.format_conversations(df.limit(0), PATH)).count() == 0
