"""Importance resampling towards a target distribution over hashed n-grams.

The bucket of an n-gram is its CRC-32 modulo the bucket count. A document's
words, joined by single blanks, are scanned once and the running CRC is kept at
every word boundary. CRC-32 is linear over GF(2): appending a string to a prefix
shifts the prefix's register by the string's length and adds the string's own
CRC. So the CRC of the words i to j is the running value at the end of j, minus
(xor) the value at the start of i shifted over the bytes between. Any n-gram
costs two look-ups and a shift, whatever its length.

The bucket numbers of all features are written once; counting them and weighing
the documents read that table and not the texts. Gains are one number a bucket.
The draw ranks by a score that holds Gumbel noise keyed by the id: a threshold
comes from counts per score, only drawn rows are sorted, by range.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from brickledger.llm.support import map_batches, reach_workers, rows_batch, stored

BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
FULL = 0xFFFFFFFF
PIECE = 1 << 20
ROWS = 512
SHORT = 64

# A-Z become a-z, digits, letters and all bytes of other characters stay, the rest separates.
_KEPT = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
              for b in range(256))


def byte_table() -> np.ndarray:
    """What one byte does to the register, by the polynomial of CRC-32 (reflected)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


_BYTE = byte_table()


def _apply(tables: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of the register, given by its images of each of the four bytes."""
    return (tables[0][values & 0xFF] ^ tables[1][(values >> 8) & 0xFF]
            ^ tables[2][(values >> 16) & 0xFF] ^ tables[3][values >> 24])


def _shift_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables that shift over 0 to 63 bytes, and over 64 times each power of two."""
    each = np.arange(256, dtype=np.uint32)
    now = np.stack([each << np.uint32(8 * i) for i in range(4)])
    short = []
    for _ in range(SHORT):
        short.append(now)
        now = _BYTE[now & 0xFF] ^ (now >> 8)
    powers = []
    for _ in range(40):
        powers.append(now)
        now = np.stack([_apply(now, now[i]) for i in range(4)])
    return np.stack(short), np.stack(powers)


_SHORT, _POWERS = _shift_tables()


def shifted(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each register value moved over so many zero bytes."""
    low = lengths % SHORT
    out = (_SHORT[low, 0, values & 0xFF] ^ _SHORT[low, 1, (values >> 8) & 0xFF]
           ^ _SHORT[low, 2, (values >> 16) & 0xFF] ^ _SHORT[low, 3, values >> 24])
    high, k = lengths // SHORT, 0
    while high.any():
        odd = np.flatnonzero(high & 1)
        out[odd] = _apply(_POWERS[k], out[odd])
        high, k = high >> 1, k + 1
    return out


def normalised(text: str) -> bytes:
    """Words in lower case (A-Z only), joined by one blank."""
    return b" ".join(text.encode().translate(_KEPT).split())


def running_crcs(stream: bytes) -> np.ndarray:
    """CRC-32 of every prefix of a stream, the empty one included.

    The stream lies in ``ROWS`` rows of equal length. The value at the start of
    each row comes from the library's own running CRC; from there all rows are
    scanned together, one column at a time.
    """
    n = len(stream)
    width = max(1, -(-n // ROWS))
    starts, value = np.empty(ROWS, np.uint32), 0
    for r in range(ROWS):
        starts[r] = value
        value = zlib.crc32(stream[r * width:(r + 1) * width], value)
    cells = np.zeros(ROWS * width, np.uint8)
    cells[:n] = np.frombuffer(stream, np.uint8)
    columns = np.ascontiguousarray(cells.reshape(ROWS, width).T)
    found = np.empty((width, ROWS), np.uint32)
    now = starts ^ np.uint32(FULL)
    for j in range(width):
        now = _BYTE[(now ^ columns[j]) & 0xFF] ^ (now >> 8)
        found[j] = now
    return np.concatenate([[np.uint32(0)], (found.T.reshape(-1)[:n] ^ np.uint32(FULL))])


def word_marks(stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of a normalised stream, and the running CRCs there.

    The scan goes in pieces, so that only boundaries are held for a long stream.
    """
    if not stream:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint32), none.astype(np.uint32)
    blanks = np.flatnonzero(np.frombuffer(stream, np.uint8) == 0x20)
    starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(stream)]])
    at_start, at_end = np.empty(len(starts), np.uint32), np.empty(len(ends), np.uint32)
    before, value = 0, 0
    for at in range(0, len(stream), PIECE):
        piece = stream[at:at + PIECE]
        # the value before the piece is put in by linearity: shift it over the bytes scanned so far
        values = running_crcs(piece)
        for marks, out in ((starts, at_start), (ends, at_end)):
            low = np.searchsorted(marks, at + (at > 0), side="left")
            high = np.searchsorted(marks, at + len(piece), side="right")
            inside = marks[low:high] - at
            out[low:high] = values[inside] ^ shifted(np.full(len(inside), before, np.uint32), inside)
        value = zlib.crc32(piece, value)
        before = value
    return starts, ends, at_start, at_end


def features(texts: list[str], shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 of all runs of ``shortest`` to ``longest`` words of each text.

    The values stand by text; then come the words and the features of each text.
    All texts form one stream, parted by a blank, and are scanned once; a run
    never leaves its text.
    """
    pieces = [normalised(t) for t in texts]
    words = np.array([p.count(b" ") + 1 if p else 0 for p in pieces], np.int64)
    starts, ends, at_start, at_end = word_marks(b" ".join(p for p in pieces if p))
    owner = np.repeat(np.arange(len(texts)), words)
    left = np.repeat(np.cumsum(words), words) - np.arange(len(owner))
    values, owners = [], []
    for n in range(shortest, longest + 1):
        first = np.flatnonzero(left >= n)
        last = first + n - 1
        values.append(at_end[last] ^ shifted(at_start[first], ends[last] - starts[first]))
        owners.append(owner[first])
    counts = np.sum([np.maximum(words - n + 1, 0) for n in range(shortest, longest + 1)], axis=0)
    if longest == shortest:
        return values[0], words, counts
    owners = np.concatenate(owners)
    return np.concatenate(values)[np.argsort(owners, kind="stable")], words, counts


_ROWS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])


def bucketed(df: DataFrame, id_col: str | None, text_col: str, shortest: int, longest: int, buckets: int) -> DataFrame:
    """Words, features and packed bucket numbers of every row, written to the shared folder."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        values, words, counts = features(texts, shortest, longest)
        packed = (values % np.uint32(buckets)).astype(kind)
        ends = np.cumsum(counts)
        yield rows_batch(_ROWS, [batch.column(0), words, counts,
                                 [packed[e - n:e].tobytes() for e, n in zip(ends.tolist(), counts.tolist())]])

    key = F.col(id_col).cast("bigint") if id_col else F.lit(None).cast("bigint")
    texts = df.select(key.alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return stored(map_batches(texts, run, "doc_id long, n_words long, n_features long, buckets binary"), "buckets")


_COUNTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])


def bucket_counts(packed: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows in each bucket. A task sends a row a bucket at most, the driver gets ``buckets`` numbers."""
    reach_workers(packed.sparkSession)
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.column(0):
                held += np.bincount(np.frombuffer(row.as_buffer(), kind), minlength=buckets)
        seen = np.flatnonzero(held)
        yield rows_batch(_COUNTS, [seen, held[seen]])

    found = packed.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, one a bucket."""
    more = len(source)
    held, wanted = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (held + more) / ((s + 1.0) * (wanted + more))))
                     for t, s in zip(target.tolist(), source.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, by the id; a null id is read as empty."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORES = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_features", "weight", "score")])


def scored(packed: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """Weight and score of every row; ``gain`` has one number a bucket."""
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, counts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        sums = [int(gain[np.frombuffer(row.as_buffer(), kind)].sum()) for row in batch.column(3)]
        weights = [s // n if n else 0 for s, n in zip(sums, counts)]
        yield rows_batch(_SCORES, [ids, batch.column(1), counts, weights, [w + noise(i, seed) for w, i in zip(weights, ids)]])

    return map_batches(packed, run, "doc_id long, n_words long, n_features long, weight long, score long")


def drawn(scores: DataFrame, fits: Column, percent: int) -> DataFrame:
    """``scores`` with ``rank``: 1, 2, ... over the best ``percent`` of the rows that fit, null for the others.

    The lowest score drawn is read from counts per score. Rows from there on are
    range-sorted and written; a row's rank is its place in its range plus the
    sizes of the ranges before. Ties go to the smaller id, a null id last.
    """
    per_score = scores.where(fits).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.col("score").desc())  # one row a score: the scores are bounded integers
    ladder = per_score.select("score", (F.sum("n").over(above) - F.col("n")).alias("before"),
                              F.sum("n").over(Window.partitionBy()).alias("fitting"))
    wanted = F.expr(f"(fitting * {int(percent)}) div 100")
    row = ladder.where(F.col("before") < wanted).agg(F.min("score").alias("least"), F.max(wanted).alias("wanted")).collect()[0]
    none = F.lit(None).cast("bigint")
    if row["least"] is None:
        return scores.withColumn("rank", none)
    chosen = fits & (F.col("score") >= row["least"])
    keys = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranged = stored(scores.where(chosen).repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "drawn")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a range
    placed = ranged.join(before, "part").withColumn(
        "rank", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*keys)))
    ranks = placed.select(*scores.columns, F.when(F.col("rank") <= row["wanted"], F.col("rank")).alias("rank"))
    return ranks.unionByName(scores.where(~chosen).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, shortest: int = 1, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    ``target`` is any table with a column of the same name as the text's. Null
    texts have no words; a row without features weighs 0. Repeated rows are
    drawn each by itself. A null id draws with the noise of an empty id. Empty
    tables give no rows, an empty target counts as all buckets alike. Other
    columns are not read.
    """
    if not 1 <= shortest <= longest:
        raise ValueError("runs must have at least one word")
    packed = bucketed(docs, id_col, text_col, shortest, longest, buckets)
    wanted = bucketed(target, None, text_col, shortest, longest, buckets)
    gain = gains(bucket_counts(wanted, buckets), bucket_counts(packed, buckets))
    scores = stored(scored(packed, gain, seed), "scores")
    return drawn(scores, F.col("n_words") >= least_words, percent)
