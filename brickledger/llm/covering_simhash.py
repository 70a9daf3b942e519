"""SimHash near-duplicates found by covering locality-sensitive hashing.

A document becomes a 64-bit fingerprint. Two fingerprints link at ``radius`` or
fewer differing bits. Every bit position gets a vector over GF(2) of radius + 1
dimensions; for each nonzero vector v a table masks the positions whose vector
is not orthogonal to v. The vectors of at most ``radius`` differing positions
leave some v orthogonal to all of them, and in the table of that v the two
masked fingerprints are equal. So every linked pair meets in some table, for
certain and not just probably.

Copies of a fingerprint are combined first; tables hold distinct fingerprints
only. Inside a bucket the links are found by comparing fingerprints, but only a
spanning forest of them leaves the task, never all pairs. Buckets too large to
be compared at once are split again by the tables of a second covering family,
which again loses no link. Components are then found by alternating star contraction.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from brickledger.llm.support import bit_count, map_batches, reach_workers, rows_batch, stored

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
SMALL, LARGE = 48, 4096
PIECE = 1 << 17


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text, unsigned.

    A-Z lower-cased, words are runs without blank, tab or line control; shingles
    of ``shingle`` words with repeats (fewer words: one of all; none: zero).
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, len(words))
    starts, ends = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), PIECE):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + PIECE], ends[at:at + PIECE])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: list[str] | None = None) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a signed long) of every row; null reads as empty. Long columns in ``also`` come along."""
    also = also or []
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "fp", *also)])

    def prints(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield rows_batch(schema, [batch.column(0), values, *batch.columns[2:]])

    texts = df.select(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit("")), *also)
    return map_batches(texts, prints, ", ".join(f"{n} long" for n in schema.names))


def covering_masks(radius: int, positions: list[int], seed: int) -> list[int]:
    """Masks over the given bit positions; any ``radius`` of them miss all the positions of some mask."""
    size = 1 << (radius + 1)
    rng = np.random.default_rng(seed)
    # every vector is dealt equally often, which makes the masks equally long
    vectors = rng.permutation(np.arange(len(positions)) % (size - 1) + 1)
    out = []
    for v in range(1, size):
        odd = bit_count(vectors & v) % 2 == 1
        out.append(sum(1 << p for p, on in zip(positions, odd) if on))
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _links(fps: np.ndarray, bucket: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by bucket, the index of the first row of each row's component inside its bucket."""
    label = np.arange(len(fps))
    edges = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate([[0], edges])
    sizes = np.diff(np.concatenate([starts, [len(fps)]]))
    size_of = np.repeat(sizes, sizes)
    pairs_a, pairs_b = [], []
    widest = int(sizes[sizes <= SMALL].max(initial=1))
    for k in range(1, widest):
        a = np.flatnonzero((bucket[k:] == bucket[:-k]) & (size_of[:-k] <= SMALL))
        near = a[bit_count(fps[a] ^ fps[a + k]) <= radius]
        pairs_a.append(near)
        pairs_b.append(near + k)
    if pairs_a:
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        while len(a):
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if np.array_equal(before, label):
                break
    for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        label[start:start + size] = start + _dense_links(fps[start:start + size], radius)
    return label


def _dense_links(fps: np.ndarray, radius: int) -> np.ndarray:
    """Components of one bucket: visit everything near the newly reached until nothing is left to visit."""
    label = np.full(len(fps), -1)
    left = np.arange(len(fps))
    while len(left):
        first = left[0]
        label[first] = first
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            near = np.zeros(len(left), bool)
            for part in range(0, len(reached), 256):
                block = reached[part:part + 256]
                open_ = np.flatnonzero(~near)
                near[open_] = (bit_count(fps[left[open_]][:, None] ^ fps[block][None, :]) <= radius).any(axis=1)
            reached, left = left[near], left[~near]
            label[reached] = first
    return label


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("whole", pa.bool_())])


def _bucket_forest(radius: int, limit: int | None):
    """Rows (key, fp) come in sorted; out go forest edges (fp, first fp of its component).

    A bucket above ``limit`` goes out row by row as (key, fp, false) instead.
    """

    def close(key: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        multi = np.concatenate([[False], key[1:] == key[:-1]])
        multi |= np.concatenate([key[1:] == key[:-1], [False]])
        key, fps = key[multi], fps[multi]
        first = _links(fps.view(np.uint64), key, radius) if len(fps) else np.zeros(0, int)
        moved = first != np.arange(len(fps))
        return rows_batch(_EDGES, [fps[moved], fps[first[moved]], np.ones(int(moved.sum()), bool)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.int64)
        passed = None  # key of the large bucket being passed on
        for batch in batches:
            key, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            if passed is not None:
                other = np.flatnonzero(key != passed)
                same = int(other[0]) if len(other) else len(key)
                if same:
                    yield rows_batch(_EDGES, [key[:same], fps[:same], np.zeros(same, bool)])
                    key, fps = key[same:], fps[same:]
                if len(key):
                    passed = None
            keys, prints = np.concatenate([keys, key]), np.concatenate([prints, fps])
            if not len(keys):
                continue
            tail = int(np.searchsorted(keys, keys[-1], side="left"))
            if limit is not None:
                starts = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
                sizes = np.diff(np.concatenate([starts, [len(keys)]]))
                big = np.repeat(sizes > limit, sizes)
                if big.any():
                    yield rows_batch(_EDGES, [keys[big], prints[big], np.zeros(int(big.sum()), bool)])
                    if big[-1]:
                        passed = keys[-1]
                    keys, prints = keys[~big], prints[~big]
                    if passed is not None:
                        tail = len(keys)
                    else:
                        tail = int(np.searchsorted(keys, keys[-1], side="left")) if len(keys) else 0
            if tail:
                yield close(keys[:tail], prints[:tail])
                keys, prints = keys[tail:], prints[tail:]
        if len(keys):
            yield close(keys, prints)

    return run


def _forest(keyed: DataFrame, radius: int, limit: int | None) -> DataFrame:
    """Forest edges of all buckets of ``keyed`` (key, fp)."""
    reach_workers(keyed.sparkSession)
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_bucket_forest(radius, limit), "a long, b long, whole boolean")


def _table_key(table: Column | int, masked: Column) -> Column:
    """One long per table and masked value. A chance collision joins two buckets, which costs comparisons only."""
    return F.xxhash64(F.lit(table) if isinstance(table, int) else table, masked)


def link_forest(prints: DataFrame, radius: int = RADIUS, seed: int = SEED, limit: int = LARGE) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, all within ``radius``-chains, that connect every linked pair."""
    masks = covering_masks(radius, list(range(BITS)), seed)
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])))
    found = stored(_forest(keyed.select(_table_key(F.col("pos"), F.col("col")).alias("key"), "fp"), radius, limit), "links")
    edges = found.where("whole").select("a", "b")
    # The rest are buckets above the limit, as (key, fp). A linked pair in them differs
    # in at most `radius` bits, so it meets again in some table of a second family over all bits.
    again = covering_masks(radius, list(range(BITS)), seed + 1)
    rest = found.where("NOT whole").select(
        F.col("a").alias("outer"), F.col("b").alias("fp"),
        F.posexplode(F.array(*[F.col("b").bitwiseAND(F.lit(signed(m))) for m in again])))
    inner = rest.select(F.xxhash64("outer", "pos", "col").alias("key"), "fp")
    return edges.unionAll(_forest(inner, radius, None).select("a", "b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of the edges.

    Alternating star contraction: each round points the neighbours of a node to
    the smallest of them, first the larger then the smaller neighbours. Minima
    combine before the shuffle, joins are on one key and can be split when it is
    hot. Every round is written to the shared folder.
    """
    current = stored(edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "stars")
    summary = F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    state = current.agg(*summary).collect()[0]
    while state[0]:
        both = current.select("u", "v").unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u != v").distinct()
        current = stored(small, "stars")
        now = current.agg(*summary).collect()[0]
        if now == state:
            break
        state = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
                    also: list[str] | None = None) -> DataFrame:
    """Per row: its id, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable over links).

    Null and empty texts have fingerprint zero, linked like any other. Repeated
    rows come back as often as they went in. Rows with a null id take part, but
    name a component only when it has no other id. An empty table gives no
    rows. Other columns are not read, but those named in ``also``, of type long,
    come along.
    """
    docs = stored(fingerprints(df, id_col, text_col, also), "prints")
    nodes = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(link_forest(nodes.select("fp"), radius))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = placed.join(lows, "root").select("fp", "component_id")
    return docs.join(by_print, "fp").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *(also or []))


def survivors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows that stay, one of each component, with all columns of ``df``: the one with the smallest id.

    Ids that are repeated are told apart by a hash of the text; rows equal in
    both stay together. A component without any id keeps its rows of null id.
    Only ids and hashes are compared, the texts stay where they are read.
    """
    key = [F.col(id_col).cast("bigint"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))]
    prints = near_duplicates(df.select(F.col(id_col), F.col(text_col), key[1].alias("text_hash")), id_col, text_col, radius, ["text_hash"])
    kept = prints.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(
        F.col(id_col).alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    return df.join(kept, key[0].eqNullSafe(kept["kept_id"]) & (key[1] == kept["kept_hash"]), "left_semi")
