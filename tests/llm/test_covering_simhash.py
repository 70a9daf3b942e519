"""Near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from brickledger.llm import covering_simhash as cs
from brickledger.llm import queries


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    """id -> smallest reachable id, comparing every pair of distinct fingerprints."""
    values = sorted(set(prints.values()))
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    array = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= radius):
            parent[find(v)] = find(values[i + 1 + j])
    low = {}
    for d, v in prints.items():
        low[find(v)] = min(low.get(find(v), d), d)
    return {d: low[find(v)] for d, v in prints.items()}


def test_every_pair_within_the_radius_meets():
    rng = random.Random(3)
    masks = cs.covering_masks(4, list(range(64)), 42)
    assert len(masks) == 31
    for _ in range(5000):
        differing = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(m & differing == 0 for m in masks)


def test_query_equals_brute_force(spark, sf_dir):
    rows = queries.registered()["op4_covering_simhash"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{p:016x}" for d, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == plain_components(prints)


@pytest.mark.parametrize("limit", [3, 60, 4096])
def test_forest_of_clusters_of_any_size(spark, limit):
    """Dense clusters, chains and noise; a low limit sends buckets through the second family."""
    rng = random.Random(7)
    values = set()
    for size in (2, 5, 40, 120):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 3))) for _ in range(size)}
    chain = rng.getrandbits(64)
    for _ in range(30):
        values.add(chain)
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
    values |= {rng.getrandbits(64) for _ in range(300)}
    prints = dict(enumerate(sorted(values)))
    df = spark.createDataFrame([(cs.signed(v),) for v in prints.values()], "fp long").repartition(5)
    roots = {r.node: r.root for r in cs.components(cs.link_forest(df, limit=limit)).collect()}
    want = plain_components(prints)
    mine = {}
    for d, v in prints.items():
        mine.setdefault(roots.get(cs.signed(v), cs.signed(v)), []).append(d)
    assert {d: min(group) for group in mine.values() for d in group} == want


def test_edge_rows(spark):
    long = "word " * 60_000
    data = [(3, None, "x", 1), (2, "", "x", 1), (9, " \t\n", "x", 1), (None, "", "x", 1), (5, long, "x", 1), (4, long, "y", 2), (4, long, "y", 2), (7, "One two", "x", 1),
            (8, "oNE  two ", "x", 1), (6, "Ä b c d e", "x", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, fp string, component_id int")
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in cs.near_duplicates(df).collect()), key=str)
    want = plain_components({i: plain_fingerprint(t) for i, t, _, _ in data if i is not None})
    assert got == sorted(((i, f"{plain_fingerprint(t):016x}", want[i] if i is not None else 2) for i, t, _, _ in data), key=str)
    kept = cs.survivors(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 4, 6, 7]
    assert cs.near_duplicates(df.limit(0)).count() == 0


def test_one_print_holding_most_rows(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a b c d e").otherwise(F.concat(F.lit("w"), "id")).alias("text"))
    assert cs.near_duplicates(df).where("component_id = 0").count() >= 1000


def test_survivors_keep_one_row_of_each_component(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=60)) for _ in range(12)]
    rows = [(i, base[i % 12] if i < 24 else base[i % 12] + " more", "x", i) for i in range(48)]
    rows += [(3, "one id for", "y", 1), (3, "two unlike texts and so for two components", "y", 2), (70, None, "z", 3), (71, "", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, text_hash long")
    low = plain_components({(r[0], k): plain_fingerprint(r[1]) for k, r in enumerate(rows)})
    kept = cs.survivors(df)
    assert kept.columns == df.columns
    got = kept.collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((d, rows[k][1] or "") for (d, k), first in low.items() if first[0] == d)
    nameless = spark.createDataFrame([(None, base[0], "x", 1), (None, base[1], "x", 2), (None, base[1], "x", 2)], df.schema)
    assert cs.survivors(nameless).count() == 3 and cs.survivors(nameless.unionAll(df)).where("doc_id IS NULL").count() == 0
    assert cs.survivors(df.limit(0)).count() == 0
