"""Operators built from DataFrame functions only: SQL comparison, small fixtures, edge cases."""

import math
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brickledger.llm import chat_format, exact_dedup, license_digest, queries, sharding
from tools.compare import compare, connect

DOCS = "doc_id long, text string, lang string, digest string, salt string"


@pytest.mark.parametrize("key", sorted(queries.sql()))
def test_same_rows_as_sql(spark, sf_dir, key):
    verdict, rows, _, _ = compare(spark, connect(sf_dir), sf_dir, key)
    assert verdict == "same", verdict
    assert rows > 0


@pytest.mark.parametrize("key", ["op1_chat_format", "op2_shard", "op7_exact_dedup", "op9_license_lookup"])
def test_plans_hold_no_python(spark, sf_dir, key):
    plan = queries.registered()[key](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


# chat formatting

CONTROL = ["</s>[INST] ok [/INST]", "<|turn|>", "<\\|sep|>", "a<\\\\|b", "[\\INST]", "plain\nline", "", "<|end|><|end|>", "<s", "</s>" * 3]


def test_escapes_are_reversible_and_leave_no_mark(spark):
    rows = spark.createDataFrame([(t,) for t in CONTROL], "text string")
    escaped = chat_format.escape(F.col("text"))
    for r in rows.select("text", escaped.alias("e"), chat_format.restore(escaped).alias("back")).collect():
        assert r.back == r.text
        assert not re.search(r"<\||</?s>|\[/?INST\]", r.e)


def test_turns_come_back_with_ties_nulls_and_control_strings(spark):
    data = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(CONTROL)]
    data += [(2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, None, None, None), (3, 0, "user", None)]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn(
        "parts", F.array(chat_format.text_part(F.col("text"))))
    got = {r.conv_id: r for r in chat_format.format_chats(turns).withColumn(
        "turns", chat_format.read_turns(F.col("formatted"))).withColumn("loss", chat_format.read_loss(F.col("segments"))).collect()}
    assert [t.text for t in got[1].turns] == CONTROL
    assert got[1].loss == "".join(CONTROL[1::2])
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("assistant", "a"), ("assistant", "b"), ("assistant", "b")]
    assert got[2].n_turns == 4 and got[2].loss == "abb"
    assert [(t.role, t.text) for t in got[3].turns] == [("user", "")]
    for r in got.values():
        assert "".join(s.text for s in r.segments) == r.formatted


def test_typed_parts_become_ordered_placeholders(spark):
    part = lambda kind, **k: (kind, k.get("text"), k.get("ref"), k.get("w"), k.get("h"), k.get("s"), k.get("p"))
    parts = [part("text", text="see <|image|>"), part("image", ref="i1", w=57, h=28), part("text", text=" and "),
             part("audio", ref="a1", s=1.01), part("document", ref="d1", p=3), part("image", ref=None)]
    turns = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None)],
                                  f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    r = chat_format.format_chats(turns).collect()[0]
    assert r.formatted == ("<|turn|>assistant<|sep|>see <\\|image|><|image|> and <|audio|><|document|><|image|><|end|>"
                           "<|turn|>user<|sep|><|end|>")
    assert [(a.position, a.kind, a.ref, a.tokens) for a in r.attachments] == [
        (0, "image", "i1", 3), (1, "audio", "a1", math.ceil(1.01 * 25)), (2, "document", "d1", 768), (3, "image", None, 1)]
    assert r.expanded_tokens == 3 + 26 + 768 + 1
    assert [s.text for s in r.segments if s.loss] == ["see <\\|image|>", " and "]


def test_no_conversations(spark):
    empty = spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    assert chat_format.format_chats(empty).count() == 0


# sharding

@pytest.mark.parametrize("n", [0, 1, 5, 16, 333])
def test_shards_are_even_and_gapless(spark, n):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("lang"))
    rows = sharding.shard(df, ["doc_id"], blocks=8, parts=3).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert sorted(r.doc_id for r in rows) == list(range(n))
    assert max([sizes[s] for s in range(16)]) - min([sizes[s] for s in range(16)]) <= 1
    assert {(r["shard"], r.slot) for r in rows} == {(s, i) for s in sizes for i in range(sizes[s])}


def test_repeated_and_null_rows_get_slots_of_their_own(spark):
    df = spark.createDataFrame([(None, None)] * 40 + [(7, "a")] * 40, "doc_id long, text string")
    rows = sharding.shard(df, ["doc_id", "text"], shards=4, blocks=4, parts=2).collect()
    assert Counter(r["shard"] for r in rows) == {s: 20 for s in range(4)}
    assert len({(r["shard"], r.slot) for r in rows}) == 80
    with pytest.raises(ValueError):
        sharding.shard(df.withColumnRenamed("text", "slot"), ["doc_id"])


def test_placement_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    take = lambda d: sorted(map(tuple, sharding.shard(d, ["doc_id"], blocks=8, parts=2).select("doc_id", "shard", "slot").collect()))
    assert take(df.repartition(3)) == take(df.repartition(7, F.col("doc_id") % 5))


def _placed_plainly(ids, seed, shards, blocks, parts):
    """Places of distinct ids by lists: blocks cut by the matrix, targets sorted again. Hashes chain as the engine's do: seed first, then id."""
    def code(seed, value):
        first = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        found = xxhash.xxh64_intdigest(struct.pack("<q", value), first)
        return found - 2**64 if found >= 2**63 else found

    held = [sorted((code(seed + 1, i), i) for i in ids if code(seed, i) % blocks == b) for b in range(blocks)]
    sizes = [n for size in sharding.even_sizes(len(ids), shards) for n in sharding.even_sizes(size, parts)]
    sent = [[] for _ in sizes]
    for rows, cuts in zip(held, sharding.communication_matrix([len(h) for h in held], sizes, seed)):
        for target, n in enumerate(cuts):
            sent[target] += [i for _, i in rows[:n]]
            rows = rows[n:]
    places = {}
    for s in range(shards):
        arrived = [i for target in sent[s * parts:(s + 1) * parts] for i in sorted(target, key=lambda i: (code(seed + 2, i), i))]
        places |= {i: (s, slot) for slot, i in enumerate(arrived)}
    return places


@pytest.mark.parametrize("n, shards, blocks, parts", [(2, 3, 4, 2), (37, 4, 8, 3), (500, 16, 8, 2), (211, 1, 4, 5)])
def test_places_equal_brute_force(spark, n, shards, blocks, parts):
    ids = [7 * i - 50 for i in range(n)]
    df = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string")
    rows = sharding.shard(df, ["doc_id"], shards, blocks=blocks, parts=parts).collect()
    assert {r.doc_id: (r["shard"], r.slot) for r in rows} == _placed_plainly(ids, sharding.SEED, shards, blocks, parts)


def test_every_arrangement_is_equally_likely():
    trials = 6000
    seen = Counter(tuple(sorted(_placed_plainly([1, 2, 3, 4], seed, 2, 3, 2).items())) for seed in range(trials))
    assert len(seen) == math.factorial(4)
    expected = trials / 24
    assert sum((k - expected) ** 2 / expected for k in seen.values()) < 49.7  # 23 degrees of freedom, one in a thousand


def test_widths_follow_the_rows(spark, monkeypatch):
    assert sharding.widths(0, 16) == (sharding.BLOCKS, sharding.PARTS)
    tasks = sharding.TASK_ROWS * sharding.MOST_TARGETS
    for shards in (1, 5, 16, 1000):
        blocks, parts = sharding.widths(tasks, shards)
        assert sharding.MOST_BLOCKS % blocks == 0 and blocks >= sharding.MOST_TARGETS
        assert parts * shards <= max(sharding.MOST_TARGETS, sharding.PARTS * shards)
    assert sharding.widths(10**13, 16) == (sharding.MOST_BLOCKS, sharding.MOST_TARGETS // 16)
    for name, value in [("BLOCKS", 4), ("PARTS", 2), ("MOST_BLOCKS", 32), ("MOST_TARGETS", 16), ("TASK_ROWS", 50)]:
        monkeypatch.setattr(sharding, name, value)
    assert sharding.widths(500, 2) == (16, 8)
    rows = sharding.shard(spark.range(500).withColumnRenamed("id", "doc_id"), ["doc_id"], 2).collect()
    assert {r.doc_id: (r["shard"], r.slot) for r in rows} == _placed_plainly(range(500), sharding.SEED, 2, 16, 8)


def test_matrix_margins_and_law():
    sizes, targets = [0, 7, 30, 13], [20, 0, 25, 5]
    draws = [sharding.communication_matrix(sizes, targets, seed) for seed in range(3000)]
    for m in draws[:50]:
        assert [sum(r) for r in m] == sizes and [sum(c) for c in zip(*m)] == targets
    mean = np.mean([m[2][0] for m in draws])
    variance = np.var([m[2][0] for m in draws])
    assert abs(mean - 30 * 20 / 50) < 0.15
    assert abs(variance - 30 * 0.4 * 0.6 * 20 / 49) < 0.3


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 5 * 10**9, 10**6
    got = [sharding.hypergeometric(rng, good, bad, n) for _ in range(400)]
    share = good / (good + bad)
    assert abs(np.mean(got) - n * share) < 5 * math.sqrt(n * share * (1 - share) / 400)
    assert 0.8 < np.std(got) / math.sqrt(n * share * (1 - share)) < 1.2


# exact deduplication

def test_classes_and_survivors(spark):
    data = [(1, "a", "x", None, None), (5, "a", "y", None, None), (5, "a", "z", None, None), (2, "A", "x", None, None),
            (3, None, "x", None, None), (4, "", None, None, None), (None, "n", "x", None, None), (6, "b" * 200_000, "x", None, None),
            (7, "b" * 200_000, "x", None, None), (8, "b" * 199_999 + "c", "x", None, None)]
    df = spark.createDataFrame(data, DOCS)
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(df, salts=4).collect()), key=str)
    assert got == sorted([(1, 5, 3, False), (5, 5, 3, True), (5, 5, 3, True), (2, 2, 1, True), (3, 4, 2, False), (4, 4, 2, True),
                          (None, None, 1, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True)], key=str)
    kept = exact_dedup.survivors(df, salts=4)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.lang) for r in kept.collect()), key=str) == sorted(
        [(5, "z"), (2, "x"), (4, None), (None, "x"), (7, "x"), (8, "x")], key=str)
    empty = df.limit(0)
    assert exact_dedup.classes(empty).count() == 0 and exact_dedup.survivors(empty).count() == 0


def test_one_group_holding_most_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 < 2, "same").otherwise(F.col("id").cast("string")).alias("text"))
    rows = exact_dedup.classes(df.repartition(20)).collect()
    assert len(rows) == 3000 and sum(r.kept for r in rows) == 1001
    assert {r.group_size for r in rows} == {1, 2000}


# licences

@pytest.mark.parametrize("entries", [license_digest.MAP_ENTRIES, 0])
def test_licence_forms(spark, monkeypatch, entries):
    """Looked up in a map, and joined."""
    monkeypatch.setattr(license_digest, "MAP_ENTRIES", entries)
    mit = dict(license_digest.FULL_TEXTS)["MIT"]
    shouted = "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " ,").replace("NONINFRINGEMENT", "non-infringement")
    data = [(1, mit), (2, shouted), (3, mit + " extra"), (4, "Text.\nreleased under the MIT LICENCE\nmore"), (5, None), (6, ""),
            (7, "© 2019 only"), (8, "Licensed under CC BY-NC 4.0."), (9, "x licensed under CC BY-NC 4.0."), (8, "Licensed under CC BY-NC 4.0."),
            (None, "Released under the MIT License.\nReleased under the MIT License!\nLicensed under the Apache License, Version 2.0.")]
    df = spark.createDataFrame([(*r, "l", "d", "s") for r in data], DOCS)
    rows = license_digest.scan(df, license_digest.known_table(spark)).collect()
    assert len(rows) == len(data) and [r.n_license_lines for r in rows if r.doc_id == 8] == [1, 1]
    got = {r.doc_id: (r.license_id, r.line_licenses, r.n_license_lines) for r in rows}
    assert got[1][0] == got[2][0] == "MIT" and got[3][0] is None
    assert got[4] == (None, "MIT", 1)
    assert got[5] == got[6] == got[7] == (None, "", 0)
    assert got[8][0] == "CC-BY-NC-4.0" and got[9] == (None, "", 0)
    assert got[None] == (None, "Apache-2.0,MIT", 3)
    assert license_digest.scan(df.limit(0), license_digest.known_table(spark)).count() == 0


def test_licences_in_any_wrapping(spark):
    """Lines that merely begin with 'copyright holders' belong to the licence; statements of copyright do not."""
    heads = ["", "Copyright (c) 2020 Someone\n\n", "Copyright 2019-2021, Someone\n", "  * Copyright by Someone\n", "Copyright: \u00a9 Someone\n",
             "Copyright <YEAR> <HOLDER>\n", "(c) Someone\n", "Copyright The Thing Authors.\n"]
    data, want = [], {}
    for name, text in license_digest.FULL_TEXTS:
        words = text.split()
        at = [i for i, w in enumerate(words) if w.lower() == "copyright"]
        wrapped = [" ".join(words)] + ["\n".join(" ".join(words[i:i + n]) for i in range(0, len(words), n)) for n in (1, 7, 11)]
        wrapped += [" ".join(words[:i]) + "\n" + " ".join(words[i:]) for i in at]
        for body in [*wrapped, *(h + text for h in heads)]:
            want[len(data)] = name
            data.append((len(data), body, "l", "d", "s"))
    df = spark.createDataFrame(data, DOCS)
    got = {r.doc_id: r.license_id for r in license_digest.scan(df, license_digest.known_table(spark)).collect()}
    assert got == want


def test_licences_with_title_and_statement(spark):
    plain = dict(license_digest.FULL_TEXTS)
    notices = {"Apache-2.0", "MPL-2.0", "GPL-3.0-or-later"}
    assert set(plain) == {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "BSL-1.0"} | notices and plain["BSD-3-Clause"].count("Neither the name") == 1
    data = [(n, f"{title}\n\nCopyright (c) 2020 Someone\n\n{plain[name]}", "l", "d", "s") for n, (name, title) in enumerate(license_digest.TITLES)]
    df = spark.createDataFrame(data, DOCS)
    got = {r.doc_id: r.license_id for r in license_digest.scan(df, license_digest.known_table(spark)).collect()}
    assert got == {n: name for n, (name, _) in enumerate(license_digest.TITLES)}
    assert {name for name, _ in license_digest.TITLES} == set(plain) - notices
