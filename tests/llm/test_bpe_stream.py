"""The transducer against the library that defines the encoding."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brickledger.llm import bpe_stream, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "aa", "e", "th", "he", "in", "er", "  ", "\n", "!!", "==", "--", "é", "日", "本", "😀", "0", "00", "\x1c", "\x85",
         " ", "'s", "'ll", "_", "<|endoftext|>", "́", "²", "Ⅷ", "ß", "İ", "​", "﻿", "\x00", "٣", "᠎"]


@pytest.fixture(scope="module")
def own():
    return bpe_stream.Transducer(bpe_stream.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    made = Tokenizer.from_file(PATH)
    return lambda text: made.encode(text, add_special_tokens=False).ids


def test_mixed_texts(own, library):
    rng = random.Random(11)
    for _ in range(1500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50)))
        ids = list(own.encode(text))
        assert ids == library(text), repr(text)
        assert "".join(own.decode(ids)) == text


@pytest.mark.parametrize("alphabet", ["a", "ab", "the", "eraintho", "=-", "01", "abcdefghijklmnopqrstuvwxyz", "éè日"])
def test_long_pieces_in_small_blocks(own, library, alphabet):
    rng = random.Random(5)
    text = "".join(rng.choice(alphabet) for _ in range(9000))
    data = text.encode()
    ids = list(own.stream(data[i:i + 700] for i in range(0, len(data), 700)))
    assert ids == library(text)


def test_tokens_are_stable_beyond_the_lookahead(own):
    """A token that ends `lookahead` bytes before the end is the same in every continuation."""
    rng = random.Random(8)
    assert 0 < own.lookahead < 1000
    tokens = [own.tokens[i] for i in range(256, 20000) if own.tokens[i].isalpha()]
    for _ in range(150):
        text = b"".join(rng.choice(tokens) for _ in range(60))
        whole = np.cumsum([len(own.tokens[t]) for t in own.stream([text])]).tolist()
        cut = rng.randint(len(text) // 2, len(text))
        part = np.cumsum([len(own.tokens[t]) for t in own.stream([text[:cut]])]).tolist()
        assert [e for e in part if e <= cut - own.lookahead] == [e for e in whole if e <= cut - own.lookahead]


def test_memory_does_not_grow(own):
    seen = []

    advance = own._advance
    own._advance = lambda held, last, before: seen.append(len(held)) or advance(held, last, before)
    assert sum(1 for _ in own.stream([b"abcdefghij" * 20_000])) > 0
    own._advance = advance
    assert max(seen) <= own.lookahead + own.longest + 3 * bpe_stream.STRIDE


def test_query_equals_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.registered()["op6_bpe_stream"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edge_rows(spark, library):
    vocabulary = bpe_stream.read_vocabulary(PATH)
    data = [(1, None, "x"), (2, "", "x"), (3, "a" * 300_000, "x"), (3, "same", "x"), (3, "same", "x"), (None, "<|endoftext|>!", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, ids string")
    got = bpe_stream.encode(df, vocabulary)
    assert sorted(((r.doc_id, list(r.ids)) for r in got.collect()), key=str) == sorted(((i, library(t or "")) for i, t, _ in data), key=str)
    back = bpe_stream.decode(got, vocabulary).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t, _ in data), key=str)
    assert bpe_stream.round_trip(df.limit(0), vocabulary).count() == 0
    assert bpe_stream.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), vocabulary).collect()[0].text == ""
    odd = spark.createDataFrame([(1, [97, None, -5, 10**9, 98])], "doc_id long, ids array<long>")
    text = bpe_stream.decode(odd, vocabulary).collect()[0].text
    assert text == library_text([97]) + "\ufffd" * 3 + library_text([98])


def library_text(ids):
    return Tokenizer.from_file(PATH).decode(ids, skip_special_tokens=False)


def test_chunks_are_the_whole_and_bounded(own, library):
    rng = random.Random(4)
    texts = [" ".join(f"word{i} <|endoftext|> é日" for i in range(2000)), "".join(rng.choice(PARTS) for _ in range(4000)),
             "".join(rng.choice(["a", " ", "\n", "\t", "'s", "1", "!", "\x85", "\u3000"]) for _ in range(4000))]
    for text in texts:
        for size in (1, 7, 500):
            parts = list(own.chunks(text, size))
            assert sum(parts, []) == library(text)
            push = own.decoder()
            assert "".join(push(p) for p in parts) + push([], True) == text
    assert max(map(len, own.chunks("word " * 50_000, 500))) <= 200
