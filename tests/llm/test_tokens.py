"""Both tokenisers against their libraries, and the Elias-Fano files."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from speechframe.llm import bpe, eliasfano
from speechframe.llm.common import shared_dir

BYTE, WORD = P.path("byte_bpe_50k.tiktoken"), P.path("word_bpe_49k.json")
ENCODER = bpe.Encoder(BYTE, P.PATTERN)
TEXTS = st.text(st.sampled_from(list("ab'st 12  \n\t\r.!,é日 　\x1c\x85̱́Hİẞ가<|>lre")), max_size=150)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_tree_is_like_the_library(text):
    leaf, grow = bpe.LEAF, bpe.GROW
    bpe.LEAF, bpe.GROW = 5, 2
    try:
        got = ENCODER.encode(text)
    finally:
        bpe.LEAF, bpe.GROW = leaf, grow
    assert got == ENCODER.leaf(text)


@settings(max_examples=200, deadline=None)
@given(TEXTS, TEXTS, TEXTS)
def test_join_is_associative(a, b, c):
    t, x, y = a + b + c, len(a), len(a) + len(b)
    e = ENCODER
    left = e.join(t, 0, y, len(t), e.join(t, 0, x, y, e.leaf(a), e.leaf(b)), e.leaf(c))
    right = e.join(t, 0, x, len(t), e.leaf(a), e.join(t, x, y, len(t), e.leaf(b), e.leaf(c)))
    assert left == right == e.leaf(t)


@pytest.mark.parametrize("text", ["x" * 30_000, "ab" * 20_000 + " " + "é" * 9_000, " " * 20_000, "\n \n" * 9_000])
def test_long_runs(text):
    assert ENCODER.encode(text) == ENCODER.leaf(text)


def test_encode_decode(spark, docs):
    rows = [(1, None), (2, ""), (3, "été 日本 " * 9000), (4, "a\r\n  b"), (4, "a\r\n  b"), (None, "<|endoftext|>")]
    got = bpe.decode(bpe.encode(docs(rows), BYTE, P.PATTERN), BYTE).collect()
    assert sorted((bytes(r.decoded).decode() for r in got)) == sorted(t or "" for _, t in rows)
    assert all(list(r.ids) == ENCODER.leaf(r.text or "") for r in got)
    both = bpe.encode(docs(rows), BYTE, P.PATTERN, decoded_col="decoded")
    assert sorted(bytes(r.decoded) for r in both.collect()) == sorted(bytes(r.decoded) for r in got)
    assert bpe.encode(docs([]), BYTE, P.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700), st.data())
def test_elias_fano(values, data):
    v = np.sort(np.array(values, np.int64))
    e = eliasfano.EliasFano.of(v)
    head, parts = e.sections()
    e = eliasfano.EliasFano.read(head, parts)
    assert (e.values() == v).all()
    for _ in range(5):
        a = data.draw(st.integers(0, len(v)))
        b = data.draw(st.integers(a, len(v)))
        assert (e.values(a, b) == v[a:b]).all()
        if a < len(v):
            assert e.select(a) == v[a]
    assert len(v) < 100 or sum(map(len, parts)) * 8 / len(v) < 2 + np.log2(max(2, v[-1] / len(v))) + 2.5


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXTS, max_size=6))
def test_chunks_are_like_the_library(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORD)
    own.encode_special_tokens = True
    got = eliasfano.chunk_tokenizer(WORD)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORD)
    rng = random.Random(1)
    rows = [(k * 7 - 50, " ".join(rng.choice(["The", "été,", "x1", "hello.", "日"]) for _ in range(rng.randint(0, 40)))) for k in range(300)]
    rows += [(1, None), (2, ""), (None, "no id"), (3, "same"), (3, "same"), (10**15, "far " * 30_000)]
    out = shared_dir(spark, "t")
    manifest = eliasfano.write_tokens(docs(rows), out, WORD)
    got = eliasfano.read_tokens(manifest).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for i, t in order:
        ids = own.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    f = manifest.orderBy("part", "seq").first()
    r = eliasfano.Reader(f.file)
    assert r.document(len(r) - 1).tolist() == r.ids(*r.span(len(r) - 1)).tolist()
    r.close()


def test_no_documents(spark, docs):
    assert eliasfano.read_tokens(eliasfano.write_tokens(docs([]), shared_dir(spark, "t"), WORD)).count() == 0


SPELT = st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|end", "oftext|>", "Hello", "É", "é", "́", " ", "\n", ".", ",", "'s", "1", "<|"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(SPELT, TEXTS), max_size=6))
def test_added_tokens_are_like_the_untouched_library(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORD)
    texts = ["hello <|endoftext|> world", "A<|endoftext|>. <|ENDOFTEXT|>", *texts]
    got = eliasfano.chunk_tokenizer(WORD)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_ordinary_documents_go_through_the_tree(monkeypatch):
    calls = []
    e = bpe.Encoder(BYTE, P.PATTERN)
    own = e.join
    monkeypatch.setattr(e, "join", lambda *a: calls.append(1) or own(*a))
    text = "Some ordinary words, of a page of text. " * 40
    assert e.encode(text) == ENCODER.leaf(text) and len(calls) >= 7
    many = list(range(1000)) * 3
    pieces = bpe.pieces_of(BYTE)
    assert bpe.decode_tree(many, pieces) == b"".join(pieces[i] for i in many)


@pytest.mark.parametrize("pattern", [r"\s*\S+", r" ?\w+| ?[^\s\w]+\s*|\s+", r"(?s:.)"])
def test_other_patterns_are_one_leaf(pattern):
    e = bpe.Encoder(BYTE, pattern)
    text = "One, two.\n three  four! " * 60
    assert e.encode(text) == e.leaf(text)
