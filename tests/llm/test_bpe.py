"""Encoding and decoding against the library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellmap.llm import bpe_speculative as b

PATH = public_tokenizers.path("byte_bpe_50k.json")
CODER, LIBRARY = b.load(PATH), Tokenizer.from_file(PATH)
ODD = ["", " ", "  a", "a  ", "\n\n x", "<|endoftext|>", "a <|endoftext|> b", "don't we'LL 's", "x" * 5000, "aaaa" * 40, "日本語🙂 ñ", "\x1c\x1d\x85 z", "1234 ²³", "é‍", "\t\tif (x):\n\t\treturn"]


def same(text):
    ids, want = CODER.encode([text])[0].tolist(), LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids == want
    assert CODER.decode(ids) == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd(text):
    same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\tabcdefghthe'sndlr.,!<|>0123éñüß")), st.characters(codec="utf-8")), max_size=60))
def test_any(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"th", b"e", b" ", b"ing", b"a", b"aa", b"ion", b"s", b"\xc3", b"\xa9", b"er", b"0"]), min_size=1, max_size=30))
def test_merging(parts):
    """Both ways of merging agree, and verified proposals are what merging gives."""
    word = b"".join(parts)
    base = [CODER.id_of[word[i : i + 1]] for i in range(len(word))]
    exact = CODER._exact_short(list(base))
    assert exact == CODER._exact_long(list(base))
    greedy = np.array(CODER._greedy(word))
    fine = CODER.reachable[greedy].all() and CODER._apart(greedy[:-1], greedy[1:]).all()
    assert fine == (greedy.tolist() == exact)


def test_operator(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((tuple(r) for r in b.encode_documents(df, PATH, digests=True).collect()), key=repr)
    want = []
    for doc, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    plain = b.encode_documents(df, PATH).filter("doc_id = 6").first()
    assert plain["ids"] == LIBRARY.encode(ODD[6], add_special_tokens=False).ids and plain["decoded"] == ODD[6]
    assert b.encode_documents(df.limit(0), PATH).count() == 0
