"""Exact k-means over integer vectors with heap-ordered bounds.

For a vector, ``upper`` is the distance to its centroid and ``lower`` the one to
the second nearest, both exact when it was last scanned. Moving centroids can
close the gap between them by at most the own centroid's move plus the largest
move of another, so every cluster accumulates that sum as its drift. A vector
enters its cluster's heap with the key gap + drift so far. As long as the key is
above the drift the vector cannot change cluster; a round pops only keys that
the drift has reached and scans those vectors exactly, in integers.

Vectors lie in blocks, each a row with its vectors, their clusters and its
heaps. A round is one narrow pass over the blocks without a shuffle; what a
block's vectors that changed cluster add to and take from the sums goes out with
the row, is added up by Spark and reaches the driver as one number per centroid
component. Blocks are written to the shared folder each round, so a lost
executor costs no more than its tasks of the round, and the round before goes.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brickledger.llm.support import reach_workers, rows_batch
from brickledger.session import Scratch

CLUSTERS, DIMS, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
BLOCK_CELLS = 1 << 18
#: Keys this close to the drift are scanned: rounding of roots and sums stays below it for all components allowed.
MARGIN = 1e-3
LARGEST = 1 << 27
FLOAT_EXACT = 1 << 22

_BLOCK = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary()), ("kind", pa.string()), ("cluster", pa.binary()),
                    ("keys", pa.binary()), ("members", pa.binary()), ("sizes", pa.binary()), ("delta", pa.binary())])
_BLOCK_SQL = "ids array<long>, vectors binary, kind string, cluster binary, keys binary, members binary, sizes binary, delta binary"


def usable(df: DataFrame, id_col: str, vector_col: str, dims: int) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows with exactly ``dims`` components, none null or non-finite."""
    vector = F.col(vector_col).cast("array<double>")
    fine = (F.size(F.coalesce(vector, F.array().cast("array<double>"))) == dims) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("vector")).where(fine)


def whole_numbers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """Components as floor(scale * x); beyond ``LARGEST`` a squared distance does not fit a long."""
    out = np.floor(vectors * float(scale))
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"a component beyond {LARGEST} after scaling: squared distances do not fit a long")
    return out.astype(np.int64)


def _blocks(dims: int, clusters: int, scale: int):
    rows = max(1, BLOCK_CELLS // max(dims, clusters))

    def block(ids: list, vectors: np.ndarray) -> pa.RecordBatch:
        kind = "<i2" if np.abs(vectors).max() < 1 << 15 else "<i8"
        none = [b""]
        return rows_batch(_BLOCK, [[ids], [vectors.astype(kind).tobytes()], [kind],
                                   [np.full(len(ids), -1, np.int32).tobytes()], none, none, none, none])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids += part.column(0).to_pylist()
                held.append(whole_numbers(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), scale))
                while len(ids) >= rows:
                    every = np.concatenate(held)
                    yield block(ids[:rows], every[:rows])
                    ids, held = ids[rows:], [every[rows:]]
        if ids:
            yield block(ids, np.concatenate(held))

    return run


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids. Doubles hold them as long as components are below ``FLOAT_EXACT``."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) < FLOAT_EXACT and vectors.shape[1] <= 64:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(axis=1) for c in centroids], axis=1)


class Block:
    """One row: vectors, the cluster of each, and a heap of (key, member) per cluster."""

    def __init__(self, ids: list, vectors: bytes, kind: str, cluster: bytes, keys: bytes, members: bytes, sizes: bytes):
        self.ids, self.kind = ids, kind
        self.vectors = np.frombuffer(vectors, kind).reshape(len(ids), -1)
        self.cluster = np.frombuffer(cluster, np.int32).copy()
        self.heaps: list[list] = []
        pairs = list(zip(np.frombuffer(keys, np.float64).tolist(), np.frombuffer(members, np.int32).tolist()))
        at = 0
        for n in np.frombuffer(sizes, np.int32).tolist():
            self.heaps.append(pairs[at:at + n])
            at += n

    def advance(self, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, int]:
        """Assign again what may have changed.

        Returns what goes to each cluster (components, count) less what leaves it, and the vectors scanned.
        """
        k = len(centroids)
        if not self.heaps:
            self.heaps = [[] for _ in range(k)]
            expired = list(range(len(self.ids)))
        else:
            expired = []
            for heap, reached in zip(self.heaps, (drift + MARGIN).tolist()):
                while heap and heap[0][0] <= reached:
                    expired.append(heapq.heappop(heap)[1])
        delta = np.zeros((k, self.vectors.shape[1] + 1), np.int64)
        if not expired:
            return delta, 0
        at = np.array(expired)
        moved = self.vectors[at].astype(np.int64)
        found = distances(moved, centroids)
        now, before = found.argmin(axis=1), self.cluster[at]
        nearest = np.sort(found, axis=1)[:, :2] if k > 1 else found
        gap = np.sqrt(nearest[:, 1]) - np.sqrt(nearest[:, 0]) if k > 1 else np.full(len(at), np.inf)
        for c, key, member in zip(now.tolist(), (gap + drift[now]).tolist(), expired):
            heapq.heappush(self.heaps[c], (key, member))
        other = now != before
        units = np.concatenate([moved, np.ones((len(at), 1), np.int64)], axis=1)[other]
        np.add.at(delta, now[other], units)
        left = before[other] >= 0
        np.subtract.at(delta, before[other][left], units[left])
        self.cluster[at] = now
        return delta, len(at)

    def packed(self, delta: np.ndarray) -> list:
        pairs = [p for heap in self.heaps for p in heap]
        changed = np.flatnonzero(delta.any(axis=1))
        rows = np.concatenate([changed[:, None], delta[changed]], axis=1)
        return [self.ids, self.vectors.tobytes(), self.kind, self.cluster.tobytes(),
                np.array([p[0] for p in pairs], np.float64).tobytes(), np.array([p[1] for p in pairs], np.int32).tobytes(),
                np.array([len(h) for h in self.heaps], np.int32).tobytes(), rows.astype(np.int64).tobytes()]


def _read(batch: pa.RecordBatch) -> Iterator[Block]:
    for i in range(batch.num_rows):
        yield Block(*(batch.column(name)[i].as_py() for name in _BLOCK.names[:-1]))


def _advanced(centroids: np.ndarray, drift: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _read(batch):
                delta, _ = block.advance(centroids, drift)
                yield rows_batch(_BLOCK, [[x] for x in block.packed(delta)])

    return run


_SUMS = pa.schema([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))])


def _changes(blocks: DataFrame, k: int, dims: int) -> list[list[int]]:
    """What the round adds to each cluster's component sums and count, as exact integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            for row in batch.column(0):
                rows = np.frombuffer(row.as_py(), np.int64).reshape(-1, dims + 2)
                held[rows[:, 0]] += rows[:, 1:]
        changed = np.flatnonzero(held.any(axis=1))
        yield rows_batch(_SUMS, [changed, held[changed].tolist()])

    parts = blocks.select("delta").mapInArrow(run, "cluster int, sums array<long>")
    cells = parts.select("cluster", F.posexplode("sums").alias("cell", "n"))
    out = [[0] * (dims + 1) for _ in range(k)]
    # one number per centroid component and count
    for r in cells.groupBy("cluster", "cell").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect():
        out[r["cluster"]][r["cell"]] = int(r["n"])
    return out


_FOUND = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


def _closed(centroids: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _read(batch):
                apart = block.vectors.astype(np.int64) - centroids[block.cluster]
                yield rows_batch(_FOUND, [block.ids, block.cluster, (apart * apart).sum(axis=1)])

    return run


def first_centroids(vectors: DataFrame, clusters: int, seed: int, scale: int) -> np.ndarray:
    """The vectors with the smallest SHA-256 of seed and id; equal ids by their components. A null id is read as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select("vector", digest.alias("digest")).orderBy("digest", "vector").limit(clusters).collect()
    return whole_numbers(np.array([r["vector"] for r in rows], np.float64), scale) if rows else np.zeros((0, 0), np.int64)


def cluster(df: DataFrame, clusters: int = CLUSTERS, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED,
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """Per usable vector ``vec_id``, ``cluster`` and exact squared ``distance``; and the final centroids.

    Vectors of another length or with a null or non-finite component are left
    out. Components become floor(scale * x). The ``clusters`` vectors with the
    smallest SHA-256 of ``seed:id`` are the first centroids, all vectors if there
    are fewer. Each round assigns to the nearest centroid (ties: smaller number)
    and sets every non-empty one to the componentwise floor of the mean; then
    vectors are assigned once more. Repeated rows and ids count each time. A
    table without usable vectors gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    reach_workers(spark)
    vectors = usable(df, id_col, vector_col, dims)
    centroids = first_centroids(vectors, clusters, seed, scale)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    with Scratch(spark) as scratch:
        blocks = scratch.store(vectors.mapInArrow(_blocks(dims, k, scale), _BLOCK_SQL), "blocks-start")
        held, drift, last = [[0] * (dims + 1) for _ in range(k)], np.zeros(k), "blocks-start"
        for turn in range(rounds + 1):
            now = f"blocks-{turn}"
            blocks = scratch.store(blocks.mapInArrow(_advanced(centroids, drift), _BLOCK_SQL), now, last)
            last = now
            if turn == rounds:
                break
            held = [[a + b for a, b in zip(*rows)] for rows in zip(held, _changes(blocks, k, dims))]
            moved = np.array([[x // row[-1] for x in row[:-1]] if row[-1] else old for row, old in zip(held, centroids.tolist())],
                             np.int64)
            moves = np.sqrt(((moved - centroids).astype(np.float64) ** 2).sum(axis=1))
            drift = drift + moves + [max((m for j, m in enumerate(moves) if j != c), default=0.0) for c in range(k)]
            centroids = moved
        found = Scratch(spark).store(blocks.mapInArrow(_closed(centroids), "vec_id long, cluster int, distance long"), "clusters")
    return found, centroids


def report(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with the sums of distances per cluster and over all, and each final centroid's digest."""
    spark = found.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # a row a cluster
    inertia = sum(r["cluster_inertia"] for r in sums)
    by = {r["cluster"]: r["cluster_inertia"] for r in sums}
    known = spark.createDataFrame([(c, by.get(c, 0), inertia, d) for c, d in digests],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
