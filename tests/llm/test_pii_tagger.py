"""Base spans against the plain expressions, gradients against differences, the tagger on held-out labelled texts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from brickledger.llm import pii_tagger as pt
from brickledger.llm import queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    out = []
    for order, (kind, expression) in enumerate(PLAIN.items()):
        for m in re.finditer(expression, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_spans_equal_the_expressions():
    rng = random.Random(9)
    parts = ["a", "Z", "é", "@", "@@", ".", "..", "-", "+", " ", "(", ")", "0", "7", "12", "255", "256", "4111111111111111", "x@y.zz",
             "1.2.3.4", "+1 (988) 555-2485", "\n", "٣", "%", "_", "000"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pt.base_spans(text) == plain_spans(text), repr(text)


def test_hostile_texts_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "a." * 150_000 + "@", "1." * 150_000, "+1" * 150_000, "@" * 300_000, "1 " * 150_000):
        pt.base_spans(text)


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    tagger = pt.Tagger(hidden=3)
    x, y = rng.integers(0, pt.CLASSES, (4, 7)), rng.integers(0, pt.TAGS, (4, 7))
    _, grads = tagger.gradient(x, y)
    for name, value in tagger.w.items():
        for _ in range(4):
            at = tuple(int(rng.integers(n)) for n in value.shape)
            kept, losses = value[at], []
            for move in (1e-5, -1e-5):
                value[at] = kept + move
                losses.append(tagger.gradient(x, y)[0])
            value[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-5 - grads[name][at]) < 1e-5, name


@pytest.fixture(scope="module")
def tagger():
    return pt.trained_tagger()


def test_held_out_labelled_texts(tagger):
    right = found = wanted = 0
    for text, spans in pt.labelled_spans(150, seed=99):
        base = pt.base_spans(text)
        got = set(base + pt.added_spans(text, tagger, base))
        want = set(spans)
        right += len({(k, a, b) for k, a, b in got if any(k == w[0] and abs(a - w[1]) <= 1 and abs(b - w[2]) <= 1 for w in want)})
        found, wanted = found + len(got), wanted + len(want)
    assert right / wanted > 0.9 and right / found > 0.93


def test_other_ways_of_writing_are_added(tagger):
    text = "Please ring (212) 555-0187 or write to jane.doe (at) example (dot) com for the form."
    base = pt.base_spans(text)
    kinds = {text[a:b]: k for k, a, b in pt.added_spans(text, tagger, base)}
    assert base == [] and kinds.get("(212) 555-0187") == "phone"


@pytest.mark.parametrize("text,want", [
    ("paid with 4465758382889437 4465758382889437 last week", ["4465758382889437"] * 2),
    ("cards 4111 1111 1111 1111 4111 1111 1111 1111 on file", ["4111 1111 1111 1111"] * 2),
    ("call 212-555-0187 212-555-0199 today", ["212-555-0187", "212-555-0199"]),
    ("ring (212) 555-0187, (212) 555-0199 or not", ["(212) 555-0187", "(212) 555-0199"]),
])
def test_neighbours_are_told_apart(tagger, text, want):
    base = pt.base_spans(text)
    spans = sorted(base + pt.added_spans(text, tagger, base), key=lambda s: s[1])
    assert [text[a:b] for _, a, b in spans] == want


def test_spoken_addresses_are_found(tagger):
    """Nine in ten of addresses written out in words, none in plain prose."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8)))
    found = 0
    for _ in range(60):
        address = f"{word()} at {word()} dot {rng.choice(['com', 'org', 'net'])}"
        text = f"{word()} {word()}, {address}, {word()} {word()} {word()}."
        found += [text[a:b] for _, a, b in pt.added_spans(text, tagger, [])] == [address]
    assert found >= 54
    assert not any(pt.added_spans(t, tagger, []) for t in ("we met at noon and saw a dot on the map", "look at the red dot there", "at 12 the dot moved"))


def test_decoding_equals_enumeration():
    """Viterbi over averaged windows against every legal sequence; spans of a kind that touch stay two."""
    rng = np.random.default_rng(4)
    tagger = pt.Tagger(hidden=3)
    tagger.w["t"] = rng.normal(size=(pt.TAGS, pt.TAGS))
    for _ in range(6):
        text = "".join(rng.choice(list("1a .-"), size=4))
        score = tagger.scores(pt.char_classes(text)[None])[0]
        best = max(itertools.product(range(pt.TAGS), repeat=4), key=lambda z: sum(score[i, t] for i, t in enumerate(z)) + sum(
            tagger.w["t"][a, b] + pt.LEGAL[a, b] for a, b in zip(z, z[1:])))
        assert tagger.tag(text).tolist() == list(best)
    runs = pt.tagged_runs(np.array([0, 5, 6, 6, 5, 6, 0, 0, 5, 0, 0, 0, 5, 7, 8, 0]))
    assert runs == [("card", [(1, 4), (4, 6), (8, 9)]), ("card", [(12, 13)]), ("phone", [(13, 15)])]


def test_windows_do_not_decide(tagger):
    """A span means the same wherever the windows happen to fall."""
    for shift in range(0, 200, 23):
        text = "word " * 40 + "item 12 and " * (shift // 8) + "x" * (shift % 7 + 1) + " at (212) 555-0187 and more words follow here"
        assert any(text[a:b] == "(212) 555-0187" for _, a, b in pt.added_spans(text, tagger, []))


def test_query_equals_the_expressions(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.registered()["op3_pii_tagger"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    extra = doubled = 0
    for r in rows:
        base = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pt.KINDS]
        assert r.base_sha256 == hashlib.sha256(pt.joined(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(pt.joined(base).split(",") if base else []) <= set(spans)
        extra += len(spans) - len(base)
        for m in re.finditer(r"(?<![0-9 ])([0-9]{16}) ([0-9]{16})(?![ 0-9])", texts[r.doc_id] or ""):
            if pt.luhn(m[1]) and pt.luhn(m[2]):  # the base rule takes both as one run and drops them
                doubled += 2
                assert {f"card:{m.start(i)}:{m.end(i)}" for i in (1, 2)} <= set(spans)
    assert doubled <= extra <= 0.02 * len(texts)


def test_edge_rows(spark, tagger):
    data = [(1, None, "x"), (2, "", "x"), (3, "a@b.cc", "x"), (3, "a@b.cc", "x"), (None, "1.2.3.4", "x"), (4, "é" * 200_000 + " a@b.cc", "x")]
    df = spark.createDataFrame(data, "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, r.spans) for r in pt.find(df, tagger).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (3, "email:0:6"), (3, "email:0:6"), (None, "ip:0:7"), (4, "email:200001:200007")], key=str)
    assert pt.find(df.limit(0), tagger).count() == 0
    assert pt.redact("see a@b.cc now", [("email", 4, 10)]) == "see <email> now"
