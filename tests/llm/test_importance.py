"""Prefix CRCs against the library's, and the draw against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from brickledger.llm import importance as im


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_features(text, shortest, longest):
    words = plain_words(text)
    return Counter(" ".join(words[i:i + n]) for n in range(shortest, longest + 1) for i in range(len(words) - n + 1))


def some_texts(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aBcÉ日9z_- 🙂", k=rng.choice([1, 2, 5, 70, 200])))
    return [rng.choice([" ", "\t\n", ", ", "\x0b!"]).join(word() for _ in range(rng.choice([0, 1, 2, 7, 40]))) for _ in range(n)]


def test_crcs_equal_the_library(monkeypatch):
    texts = some_texts(2, 60) + ["", "?!", "x" * 5000]
    for piece in (1 << 20, 97, 1):
        monkeypatch.setattr(im, "PIECE", piece)
        some = texts if piece > 1 else texts[:6]
        for low, high in ((1, 1), (1, 3), (2, 2), (4, 5)):
            values, words, counts = im.features(some, low, high)
            at = 0
            for t, n, m in zip(some, words, counts):
                want = Counter(zlib.crc32(f.encode()) for f in plain_features(t, low, high).elements())
                assert n == len(plain_words(t)) and Counter(values[at:at + m].tolist()) == want
                at += m
            assert at == len(values)


def test_shift_over_long_gaps():
    for n in (0, 1, 63, 64, 65, 4096, 1_000_003):
        a, b = b"prefix", b"q" * n
        assert int(im.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def plain_draw(docs, wanted, shortest, longest, buckets, percent, least):
    of = [plain_features(t, shortest, longest) for _, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for held, texts in ((s, of), (t, [plain_features(x, shortest, longest) for x in wanted])):
        for f in texts:
            for k, n in f.items():
                held[bucket(k)] += n
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for (i, text), f in zip(docs, of):
        weight = sum(gain[bucket(k)] * n for k, n in f.items()) // f.total() if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(plain_words(text))))
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = Counter()
    drawn = [(*r[:4], k + 1) for k, r in enumerate(fit[:percent * len(fit) // 100])]
    rest = Counter(r[:4] for r in rows) - Counter(r[:4] for r in drawn)
    return sorted(drawn + [(*r, None) for r in rest.elements()], key=str)


@pytest.mark.parametrize("low,high,buckets,percent", [(1, 1, 50, 30), (1, 2, 997, 10), (2, 3, 70_000, 100), (1, 1, 10, 0)])
def test_draw_equals_brute_force(spark, low, high, buckets, percent):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words[:rng.choice([3, 60])], k=rng.choice([0, 3, 19, 20, 50])))) for i in range(400)]
    docs += [(None, " ".join(words)), (5, docs[5][1]), (5, " ".join(words)), (900, None), (901, "A " * 3000)]
    wanted = [" ".join(rng.choices(words[:10], k=30)) for _ in range(12)] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS rank", "2 AS buckets").repartition(5)
    target = spark.createDataFrame([(t,) for t in wanted], "text string")
    got = im.resample(df, target, low, high, buckets, percent=percent)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()), key=str) == plain_draw(
        docs, wanted, low, high, buckets, percent, 20)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a " * 30), (2, "b " * 30)], "doc_id long, text string")
    assert im.resample(docs.limit(0), docs).count() == 0
    rows = im.resample(docs, docs.limit(0), percent=50).collect()
    assert sorted(r.rank or 0 for r in rows) == [0, 1]
