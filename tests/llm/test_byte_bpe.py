"""Byte-level BPE against the tiktoken library."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import byte_bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
# U+10940 and U+0558 are letters for one library and not for the other.
PARTS = [" ", "  ", "\n", "'s", "'re", "'", "a", "the", "ing", "é", "ß", "中文", "字", "한국", "1", "23", "½", "\U00010940", "՘",
         "ال", "!", "...", "\t", "😀", "‍", "\x85", "　", "Жи"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=40).map("".join)


@pytest.fixture(scope="module")
def library():
    ranks = byte_bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.encoder(PATH, P.PATTERN)


def ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(text=TEXT | st.text(max_size=60))
def test_ids_are_those_of_the_library(library, own, text):
    packed = own.encode(text)
    assert ids(packed) == library.encode_ordinary(text)
    assert own.decode(packed) == text.encode()


@settings(max_examples=300, deadline=None)
@given(old=TEXT, new=TEXT, at=st.integers(0, 50), length=st.integers(0, 6))
def test_an_edit_gives_the_ids_of_the_whole_text(library, own, old, new, at, length):
    edited = old[:at] + new + old[at + length :]
    found, _ = own.revise(old, library.encode_ordinary(old), edited)
    assert found == library.encode_ordinary(edited)


def test_an_edit_encodes_only_its_surroundings(library, own):
    old = "several words of a long text " * 500
    new = old[:7000] + "!" + old[7000:]
    found, made = own.revise(old, library.encode_ordinary(old), new)
    assert found == library.encode_ordinary(new)
    assert made < 30


@settings(max_examples=200, deadline=None)
@given(raw=st.binary(max_size=60), more=st.binary(max_size=20), at=st.integers(0, 60), length=st.integers(0, 5))
def test_tables_of_prefixes_are_extended_and_edited_exactly(own, raw, more, at, length):
    table = byte_bpe.Prefixes(own.vocabulary, raw)
    before = list(table.last)
    table.append(more)
    assert table.last[: len(before)] == before
    assert table.last == byte_bpe.Prefixes(own.vocabulary, raw + more).last
    at = min(at, len(raw + more))
    stop = min(at + length, len(raw + more))
    table.replace(at, stop, b"x")
    assert table.last == byte_bpe.Prefixes(own.vocabulary, (raw + more)[:at] + b"x" + (raw + more)[stop:]).last


def test_an_edit_of_a_long_piece_meets_the_old_table(own):
    raw = ("wort" * 2000).encode()
    table = byte_bpe.Prefixes(own.vocabulary, raw)
    assert table.replace(4000, 4001, b"q") < 200
    assert table.ids() == byte_bpe.Prefixes(own.vocabulary, raw[:4000] + b"q" + raw[4001:]).ids()


def test_long_texts_are_cut_in_slices(library, own, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE", 40)
    text = "it's a text'll go on  " * 30 + " " * 300 + "x" + "letters" * 40
    assert ids(own.encode(text)) == library.encode_ordinary(text)


def test_rows(spark, library):
    texts = [None, "", " \t\n", "it's <|endoftext|> Grüße 中文", "it's <|endoftext|> Grüße 中文", "ab " * 60_000]
    rows = [(i, t, "name", 1) for i, t in enumerate(texts)] + [(None, "x", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, n_tokens int")
    found = sorted(map(tuple, byte_bpe.digests(docs, PATH, P.PATTERN).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        n = library.encode_ordinary(t or "")
        want.append((i, len(n), hashlib.sha256(np.array(n, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert found == sorted(want, key=repr)
    encoded = byte_bpe.encode(docs, PATH, P.PATTERN)
    assert {r.doc_id: bytes(r.decoded).decode() for r in byte_bpe.decode(encoded, PATH, P.PATTERN).collect()} == {i: t or "" for i, t, *_ in rows}
    assert byte_bpe.digests(docs.limit(0), PATH, P.PATTERN).collect() == []


def test_texts_are_re_encoded(spark, library):
    rows = [(1, "a b c", library.encode_ordinary("a b c"), "a bb c"), (2, None, None, "new"), (3, "gone", library.encode_ordinary("gone"), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>, new_text string")
    found = {r.doc_id: r.ids for r in byte_bpe.re_encode(docs, PATH, P.PATTERN).collect()}
    assert found == {i: library.encode_ordinary(new or "") for i, _, _, new in rows}
