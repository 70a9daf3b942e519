"""Heap-ordered bounds against plain k-means in integers."""

import hashlib
import math

import numpy as np
import pytest

from brickledger.llm import heap_kmeans as hk


def plain(rows, clusters, dims, rounds, scale, seed):
    """Full scans with Python integers: {row number: (id, cluster, distance)} and the centroids."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:clusters]]
    for turn in range(rounds + 1):
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for k in range(len(centroids)):
                own = [v for (_, v), (_, z) in zip(kept, near) if z == k]
                if own:
                    centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    return sorted((str(i), z, d) for (i, _), (d, z) in zip(kept, near)), centroids


def same(spark, rows, clusters=5, dims=3, rounds=5, scale=256, schema="vec_id long, embedding array<double>"):
    df = spark.createDataFrame(rows, schema)
    found, centroids = hk.cluster(df, clusters, dims, rounds, scale, 2)
    want, wanted = plain(rows, clusters, dims, rounds, scale, 2)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in found.collect()) == want
    assert centroids.tolist() == wanted
    return hk.report(found, centroids) if len(centroids) else found


def test_equals_plain_rounds_in_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    spots = rng.normal(size=(9, 3)) * 3
    rows = [(i, (spots[i % 9] + rng.normal(size=3)).tolist()) for i in range(700)]
    monkeypatch.setattr(hk, "BLOCK_CELLS", 120)
    out = same(spark, rows, clusters=7).collect()
    by = {}
    for r in out:
        by.setdefault(r.cluster, []).append(r)
    assert {r.inertia for r in out} == {sum(r.distance for r in out)}
    for own in by.values():
        assert {r.cluster_inertia for r in own} == {sum(r.distance for r in own)} and len({r.centroid_sha256 for r in own}) == 1


def test_ties_copies_and_empty_clusters(spark):
    same(spark, [(i, [float(i % 3), 0.0, 0.0]) for i in range(60)], clusters=6)          # lattice points, equal centroids
    same(spark, [(i, [1.0, -2.0, 0.5]) for i in range(40)] + [(99, [5.0, 5.0, 5.0])], clusters=4)  # one vector of many copies
    same(spark, [(7, [float(i), 0.0, 1.0]) for i in range(30)] + [(None, [2.0, 2.0, 2.0])] * 3, clusters=4)  # one id for all
    same(spark, [(i, [float(i), -1.0, 2.0]) for i in range(3)], clusters=8)              # fewer vectors than clusters
    same(spark, [(i, [float(i), 3.0, 2.0]) for i in range(9)], clusters=1)


def test_unusable_vectors_are_left_out(spark):
    rows = [(1, [0.1, 0.2, 0.3]), (2, None), (3, []), (4, [0.1, None, 0.2]), (5, [0.1, float("nan"), 0.2]), (6, [0.1, float("inf"), 0.2]),
            (7, [0.1, 0.2]), (8, [0.1, 0.2, 0.3, 0.4]), (9, [-0.4, 0.9, 0.0]), (None, [0.0, 0.0, 0.0])]
    same(spark, rows, clusters=2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    extra = df.selectExpr("*", "1 AS cluster", "'x' AS distance", "2 AS delta")
    assert hk.cluster(extra, 2, 3)[0].columns == ["vec_id", "cluster", "distance"]
    found, centroids = hk.cluster(df.where("vec_id IN (2, 3)"), 2, 3)
    assert found.count() == 0 and hk.report(found, centroids).count() == 0
    assert hk.cluster(df.limit(0), 2, 3)[0].count() == 0


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2**26, 2**26, 3)]) for i in range(60)]
    same(spark, rows, clusters=5, scale=1)
    with pytest.raises(Exception, match="do not fit a long"):
        hk.cluster(spark.createDataFrame([(1, [2.0**40, 0.0, 0.0])], "vec_id long, embedding array<double>"), 1, 3)


def test_few_vectors_are_scanned_again():
    rng = np.random.default_rng(5)
    spots = rng.normal(size=(8, 16)) * 900
    vectors = np.floor(np.repeat(spots, 200, axis=0) + rng.normal(size=(1600, 16)) * 30).astype(np.int64)
    block = hk.Block(list(range(1600)), vectors.astype("<i2").tobytes(), "<i2", np.full(1600, -1, np.int32).tobytes(), b"", b"", b"")
    centroids, drift, scans = vectors[::200] + 20, np.zeros(8), []
    for _ in range(4):
        delta, scanned = block.advance(centroids, drift)
        scans.append(scanned)
        assert (block.cluster == hk.distances(vectors, centroids).argmin(axis=1)).all()
        # written and read again, the heaps are the same
        block = hk.Block(*block.packed(delta)[:-1])
        new = np.stack([vectors[block.cluster == c].sum(axis=0) // max(1, (block.cluster == c).sum()) for c in range(8)])
        moves = np.sqrt(((new - centroids) ** 2).sum(axis=1))
        drift = drift + moves + [max(m for j, m in enumerate(moves) if j != c) for c in range(8)]
        centroids = new
    assert scans[0] == 1600 and sum(scans[1:]) < 160
