"""Decontamination against brute force over all windows and items."""

import random
from collections import Counter

import numpy as np
import pytest

from brickledger.llm import decontaminate as dc
from brickledger.llm import queries


def plain_hits(text, items):
    """Best similarity of each item over every window of its size (a shorter text as a whole), no fingerprints."""
    words, out = dc.words_of(text), {}
    for item, content in items:
        want = dc.words_of(content)
        m = len(want)
        width, span = min(5, m), min(m, len(words))
        if not m or span < width:
            continue
        weights = Counter(tuple(want[i:i + width]) for i in range(m - width + 1))
        best = max(dc.similarity(Counter(tuple(words[s + i:s + i + width]) for i in range(span - width + 1)), weights)
                   for s in range(len(words) - span + 1))
        if best >= 0.8:
            out[item] = best
    return out


def test_query_equals_brute_force(spark, sf_dir):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    vocabulary = [set(dc.words_of(t)) for _, t in items]
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        present = set(dc.words_of(r.text or ""))
        # a window of similarity 0.8 misses at most a fifth of the item's words
        near = [item for item, own in zip(items, vocabulary) if len(own & present) >= 0.5 * len(own)]
        for item, score in plain_hits(r.text or "", near).items():
            want[r.doc_id, item] = round(score, 9)
    rows = queries.registered()["op8_decontamination"](spark, sf_dir).collect()
    assert want and {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == want


def edited(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def test_edited_passages_of_all_sizes():
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 3, 5, 9, 30, 40, 40, 120])]
    index = dc.Index(items)
    seen = set()
    for trial in range(200):
        item, text = rng.choice(items)
        words = edited(rng, dc.words_of(text), rng.randint(0, 3))
        around = [word() for _ in range(60)]
        doc = " ".join(around[:25] + words + around[25:])
        got = {i: round(s, 9) for i, s, _, _ in index.search(doc)}
        assert got == {i: round(s, 9) for i, s in plain_hits(doc, items).items()}, (trial, item)
        seen |= set(got)
    assert seen == {i for i, _ in items}


def test_a_text_shorter_than_the_item_is_one_window():
    words = [f"w{i}" for i in range(40)]
    index = dc.Index([(7, " ".join(words))])
    for n in range(25, 41):
        hits = index.search(" ".join(words[:n]))
        assert {h[0]: h[1] for h in hits} == plain_hits(" ".join(words[:n]), [(7, " ".join(words))]), n
    assert index.search(" ".join(words[:34])) and not index.search(" ".join(words[:32]))


@pytest.mark.parametrize("cells", [dc.CELLS, 1])
def test_blocks_return_everything_within_the_radius(monkeypatch, cells):
    monkeypatch.setattr(dc, "CELLS", cells)
    rng = np.random.default_rng(3)
    own = dc.Sized(ids=list(range(40)), weights=[Counter({f"s{i}": 1}) for i in range(40)])
    own.close(5)
    for item in range(40):
        for bits in (0, 5, dc.RADIUS):
            flipped = own.prints[item] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, bits, replace=False)))
            windows, items, distances = own.candidates(np.array([flipped], np.uint64))
            found = dict(zip(items.tolist(), distances.tolist()))
            assert found[item] == bits
            assert found == {i: int(np.bitwise_count(p ^ flipped)) for i, p in enumerate(own.prints) if np.bitwise_count(p ^ flipped) <= dc.RADIUS}


def test_edge_rows_pieces_and_clean(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    data = [(1, None, "x", 1), (2, "", "x", 1), (3, f"Before. {item.upper()}!", "x", 1), (3, f"Before. {item.upper()}!", "x", 1), (4, "one two three", "x", 1),
            (5, "filler " * 100_000 + item, "x", 1), (6, f"{item} {item}", "x", 1), (None, item, "x", 1), (7, "solo", "x", 1), (8, "other text of no item", "x", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, item_id string, similarity int")
    bench = spark.createDataFrame([(10, item, 1), (11, item, 1), (11, item, 2), (12, None, 1), (13, " ?! ", 1), (14, "Solo", 1), (None, item, 1)], "item_id long, text string, doc_id int")
    for chars in (10, 10**6):
        rows = dc.matches(df, bench, chars=chars).collect()
        assert Counter((r.doc_id, r.item_id) for r in rows) == Counter(
            [(d, i) for d in (3, 3, 5, 6, None) for i in (10, 11)] + [(7, 14)])
        assert {r.similarity for r in rows} == {1.0}
        assert {r.first_word for r in rows if r.doc_id == 6} == {0} and {r.first_word for r in rows if r.doc_id == 5} == {100_000}
        kept = dc.clean(df, bench, chars=chars)
        assert kept.schema == df.schema and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 8]
    assert dc.matches(df.limit(0), bench).count() == 0 and dc.matches(df, bench.limit(0)).count() == 0
    assert dc.clean(df, bench.limit(0)).count() == len(data)
