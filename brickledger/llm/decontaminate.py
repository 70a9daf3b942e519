"""Benchmark decontamination by SimHash over item-sized windows.

A benchmark item of m words is looked for in every window of m words of a text.
Item and window are weighted sets of five-word shingles (weight: how often it
occurs) with a 64-bit SimHash. A multi-index over blocks of the items'
fingerprints returns every item within the Hamming radius of a window: of eight
blocks of eight bits, at least one differs in two bits or fewer when the whole
differs in 23 or fewer, and each block is entered under all its values within
two bits. Candidates are then verified by the exact weighted Jaccard similarity. A text of
fewer words than the item is compared as a whole.

A window that is similar at all shares a shingle with the item, so only windows
around shared shingles are fingerprinted; this loses nothing. Window sums slide
over a text, so a fingerprint costs a subtraction.

The items are a stated query set, held in pieces of bounded size; every piece
is run against all rows. Nothing that grows with the documents is broadcast, and
documents do not meet each other: there is no shuffle, and no hot key.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from brickledger.llm.support import map_batches, rows_batch

WORD = re.compile(r"\w+")
SHINGLE = 5
LEAST = 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
PIECE_CHARS = 8_000_000
SPAN = 20_000
CELLS = 4_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _combined(ids: np.ndarray, width: int) -> np.ndarray:
    """One number per run of ``width`` word numbers."""
    runs = len(ids) - width + 1
    out = np.zeros(runs, np.uint64)
    for i in range(width):
        out = out * BASE + ids[i:i + runs]
    return out


def _signs(shingles: list[str]) -> np.ndarray:
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: shared weight by total weight."""
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


@dataclass
class Sized:
    """Items of one length in words: ids, shingle weights, fingerprints and the block tables."""

    ids: list[int] = field(default_factory=list)
    weights: list[Counter] = field(default_factory=list)
    prints: np.ndarray | None = None
    table: np.ndarray | None = None

    def close(self, width: int) -> None:
        sums = np.stack([_signs(list(w)).T @ np.array(list(w.values())) for w in self.weights])
        self.prints = _packed(sums)
        near = [sum(1 << b for b in bits) for n in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), n)]
        # a bit an item: 256 bytes an item in all
        self.table = np.zeros((BLOCKS, 1 << BLOCK_BITS, -(-len(self.ids) // 8)), np.uint8)
        blocks = self.prints.view(np.uint8).reshape(-1, BLOCKS)
        for block in range(BLOCKS):
            met = np.zeros((1 << BLOCK_BITS, len(self.ids)), bool)
            for d in near:
                met[blocks[:, block] ^ d, np.arange(len(self.ids))] = True
            self.table[block] = np.packbits(met, axis=1)

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all items within the radius of each window's fingerprint; ``CELLS`` pairs are looked at at a time."""
        blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
        out = []
        step = max(1, CELLS // len(self.ids))
        for start in range(0, len(prints), step):
            part = blocks[start:start + step]
            met = self.table[0, part[:, 0]]
            for block in range(1, BLOCKS):
                met = met | self.table[block, part[:, block]]
            window, item = np.nonzero(np.unpackbits(met, axis=1, count=len(self.ids)))
            window += start
            distance = np.bitwise_count(prints[window] ^ self.prints[item])
            near = distance <= RADIUS
            out.append((window[near], item[near], distance[near]))
        return tuple(np.concatenate(x) for x in zip(*out))


class Index:
    """The items of one piece."""

    def __init__(self, items: list[tuple[int, str]]):
        self.sized: dict[int, Sized] = {}
        self.vocabulary: dict[str, int] = {}
        runs: dict[int, dict[int, set[int]]] = {}  # width: run number: item lengths that hold it
        for item, text in items:
            words = words_of(text)
            m = len(words)
            if not m:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            width = min(SHINGLE, m)
            own = self.sized.setdefault(m, Sized())
            own.ids.append(item)
            own.weights.append(Counter(" ".join(words[i:i + width]) for i in range(m - width + 1)))
            for run in _combined(ids, width).tolist():
                runs.setdefault(width, {}).setdefault(run, set()).add(m)
        for m, own in self.sized.items():
            own.close(min(SHINGLE, m))
        self.runs = {width: (np.array(sorted(found), np.uint64), found) for width, found in runs.items()}

    def search(self, text: str, least: float = LEAST) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word of the window, differing bits) of the best window of each item found."""
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        known = ids > 0
        best: dict[int, tuple[float, int, int]] = {}
        for width, (sorted_runs, lengths) in self.runs.items():
            if len(words) < width:
                continue
            full = np.convolve(known, np.ones(width, int), "valid") == width if width > 1 else known
            at = np.flatnonzero(full)
            if not len(at):
                continue
            number = _combined(ids, width)[at]
            place = np.minimum(np.searchsorted(sorted_runs, number), len(sorted_runs) - 1)
            shared = sorted_runs[place] == number
            anchors: dict[int, list[int]] = {}
            for position, run in zip(at[shared].tolist(), number[shared].tolist()):
                for m in lengths[run]:
                    anchors.setdefault(m, []).append(position)
            for m, positions in anchors.items():
                self._windows(words, m, width, positions, least, best)
        return [(item, *found) for item, found in sorted(best.items())]

    def _windows(self, words: list[str], m: int, width: int, positions: list[int], least: float, best: dict) -> None:
        """Windows of m words that hold a shared shingle, in stretches of bounded length.

        A text shorter than the item is one window.
        """
        span = min(m, len(words))
        if span - width + 1 < least * (m - width + 1):
            return  # too short for the similarity asked for
        marks = np.array(positions)
        lows, highs = np.maximum(marks - (span - width), 0), np.minimum(marks, len(words) - span)
        keep = lows <= highs
        at, stop = -1, -1
        for low, high in zip(lows[keep].tolist(), highs[keep].tolist()):
            if at >= 0 and low <= stop + 1 and high - at < SPAN:
                stop = max(stop, high)
                continue
            if at >= 0:
                self._stretch(words, m, span, width, at, stop, least, best)
            at, stop = (max(low, stop + 1), high) if at >= 0 else (low, high)
        if at >= 0 and stop >= at:
            self._stretch(words, m, span, width, at, stop, least, best)

    def _stretch(self, words: list[str], m: int, span: int, width: int, start: int, stop: int, least: float, best: dict) -> None:
        """All windows of ``span`` words starting from ``start`` to ``stop``, both included."""
        if stop < start:
            return
        own = self.sized[m]
        part = words[start:stop + span]
        shingles = [" ".join(part[i:i + width]) for i in range(len(part) - width + 1)]
        sums = np.concatenate([np.zeros((1, BLOCKS * BLOCK_BITS), np.int32), np.cumsum(_signs(shingles), axis=0, dtype=np.int32)])
        size = span - width + 1
        windows, items, distances = own.candidates(_packed(sums[size:] - sums[:-size]))
        made: dict[int, Counter] = {}
        for w, i, d in zip(windows.tolist(), items.tolist(), distances.tolist()):
            if w not in made:
                made[w] = Counter(shingles[w:w + size])
            score = similarity(made[w], own.weights[i])
            if score >= least:
                found = (score, start + w, d)
                held = best.get(own.ids[i])
                if held is None or (-found[0], found[1]) < (-held[0], held[1]):
                    best[own.ids[i]] = found


def pieces(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", chars: int = PIECE_CHARS) -> Iterator[Index]:
    """Indexes over the benchmark, each of about ``chars`` characters of item text; one is held at a time.

    Rows come over partition by partition. Items with a null id or text are no items.
    """
    held: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("bigint"), F.col(text_col)).dropna().distinct()
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += len(text)
        if size >= chars:
            yield Index(sorted(held))
            held, size = [], 0
    if held:
        yield Index(sorted(held))


_HITS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()),
                   ("distance", pa.int32())])
_HITS_SQL = "doc_id long, item_id long, similarity double, first_word long, distance int"


def _search(df: DataFrame, index: Index, id_col: str, text_col: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(index)  # one piece, of bounded size

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found += [(doc, *hit) for hit in shared.value.search(text)]
        if found:
            yield rows_batch(_HITS, list(map(list, zip(*found))))

    texts = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return map_batches(texts, work, _HITS_SQL)


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars: int = PIECE_CHARS) -> DataFrame:
    """One row per document row and benchmark item found in it: the best window (first of equals), by similarity.

    Words are runs of letters, digits and underscores, lower-cased. Items and
    texts without a word match nothing, items of fewer than five words only as a
    whole. A document row that is repeated reports its items each time. Null
    texts report none. An empty table or benchmark gives no rows. Only the two
    named columns of each table are read.
    """
    found = [_search(df, index, id_col, text_col) for index in pieces(benchmark, text_col="text", chars=chars)]
    if not found:
        return df.sparkSession.createDataFrame([], _HITS_SQL).withColumnRenamed("doc_id", id_col)
    return reduce(DataFrame.unionAll, found).withColumnRenamed("doc_id", id_col)


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", chars: int = PIECE_CHARS) -> DataFrame:
    """The rows in which no item is found, with all their columns, null texts included. Rows stay where they are: no join."""
    at = df.columns.index(text_col)
    for index in pieces(benchmark, chars=chars):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def work(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([t is None or not shared.value.search(t) for t in texts], pa.bool_()))

        df = map_batches(df, work, df.schema)
    return df
