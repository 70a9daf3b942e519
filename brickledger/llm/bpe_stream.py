"""Byte-level BPE as a streaming transducer with bounded lookahead.

The encoder reads bytes left to right and keeps, for every prefix, the last token
of the prefix's encoding. That token is unique: among the vocabulary tokens that
end here, it is the one that may follow the last token of the prefix before it,
where two tokens may be neighbours when no merge crosses their border. The chain
of last tokens is the encoding so far. A token becomes stable once as many bytes
have followed as the merge list's sufficient lookahead; it is then emitted and
forgotten, so memory does not grow with the text.

The lookahead is computed from the merge list. What happens at a border can
depend on the right only through a chain of merges in which each is of higher
priority than the one it disturbs and takes away the token that one needed;
priorities fall strictly along the chain, so the longest chain, weighted by the
bytes of the tokens it needs, is finite and found in one pass over the list.

Decoding is an incremental state machine from bytes to text.
"""

from __future__ import annotations

import array
import codecs
import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from brickledger.llm.support import map_batches, rows_batch

# Fixed value: the pattern by which this family of vocabularies splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES, PAIRS = 160_000, 400_000
STRIDE = 1024
CHUNK = 1 << 16
UNKNOWN = "\ufffd".encode()


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in vocabulary files: visible Latin-1 as itself, the rest from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Vocabulary:
    """What a tokenizer file says: bytes of each id, merges in order as id triples, special strings."""

    tokens: dict[int, bytes]
    merges: list[tuple[int, int, int]]
    special: dict[str, int] = field(default_factory=dict)


def read_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE tokenizer file (JSON) on the driver; a vocabulary is of bounded size."""
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    alphabet = byte_alphabet()
    ids = given["model"]["vocab"]
    special = {t["content"]: t["id"] for t in given["added_tokens"]}
    tokens = {i: bytes(alphabet[c] for c in t) for t, i in ids.items() if t not in special}
    tokens |= {i: t.encode() for t, i in special.items()}
    pairs = (m if isinstance(m, list) else m.split(" ") for m in given["model"]["merges"])
    return Vocabulary(tokens, [(ids[a], ids[b], ids[a + b]) for a, b in pairs], special)


class Transducer:
    """Encoder and decoder of one vocabulary; ``lookahead`` is in bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        self.special = vocabulary.special
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: (rank, left, right)
        self.id_of = {t: i for i, t in self.tokens.items() if len(t) == 1 and i not in self.special.values()}
        for rank, (a, b, t) in enumerate(vocabulary.merges):
            self.rank.setdefault((a, b), rank)
            if t not in self.made and len(self.tokens[t]) > 1:
                self.made[t] = (rank, a, b)
        self.may: dict[int, bool] = {}
        for t, (rank, a, b) in self.made.items():
            if self._apart(a, b, rank):  # else the merge can never happen
                self.id_of[self.tokens[t]] = t
        self.longest = max((len(t) for t in self.id_of), default=1)
        # tokens read from their last byte on: (state, byte) -> state, and the token that is complete in a state
        self.go: dict[int, int] = {}
        self.full: list[int] = [-1]
        for token, t in self.id_of.items():
            state = 0
            for byte in reversed(token):
                state = self.go.setdefault(state << 8 | byte, len(self.full))
                if state == len(self.full):
                    self.full.append(-1)
            self.full[state] = t
        self.lookahead = self._sufficient_lookahead(vocabulary.merges)
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN)
        self.edge = regex.compile(r"(?<=\S)\s")
        marks = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(marks) + ")") if marks else None

    def _sufficient_lookahead(self, merges: list[tuple[int, int, int]]) -> int:
        """Bytes beyond a token's end on which the token can depend, at most.

        ``reach[s]``: longest chain set off by the merges seen so far whose left
        token is s. ``inner[t]``: the same for the tokens at t's right edge, which
        exist only until t is made of them. A merge (s, d) needs the bytes of d, and
        whatever d itself depends on by then.
        """
        reach: dict[int, int] = {}
        inner: dict[int, int] = {}
        for a, b, t in merges:
            need = len(self.tokens[b]) + max(reach.get(b, 0), inner.get(b, 0))
            if t not in inner:
                inner[t] = max(inner.get(b, 0), reach.get(b, 0))
            reach[a] = max(reach.get(a, 0), need)
        return max([0, *reach.values(), *inner.values()])

    def _apart(self, x: int, y: int, limit: float) -> bool:
        """Whether no merge of a rank below ``limit`` crosses the border of the neighbours x and y.

        Goes back in time: of the two tokens at the border the one made last is
        taken apart, and the merge that would have crossed must have come before
        that. Of equal ranks the left one was made first.
        """
        while True:
            crossing = self.rank.get((x, y))
            if crossing is not None and crossing < limit:
                return False
            left, right = self.made.get(x), self.made.get(y)
            if left is None and right is None:
                return True
            if right is None or left is not None and left[0] > right[0]:
                limit, x = left[0], left[2]
            else:
                limit, y = right[0] + 1, right[1]

    def _neighbours(self, x: int, y: int) -> bool:
        known = self.may.get(x << 32 | y)
        if known is None:
            if len(self.may) >= PAIRS:
                self.may.clear()
            known = self.may[x << 32 | y] = self._apart(x, y, float("inf"))
        return known

    def _advance(self, held: bytes | bytearray, last: list[int], before: int) -> None:
        """Extend ``last`` (token ending after each held byte) to all of ``held``; ``before`` is the token in front, or -1."""
        go, full, may = self.go, self.full, self.may
        for n in range(len(last), len(held)):
            state, at, fits = 0, n, -1
            while at >= 0:
                state = go.get(state << 8 | held[at])
                if state is None:
                    break
                t = full[state]
                if t >= 0:
                    previous = last[at - 1] if at else before
                    if previous >= 0:
                        fine = may.get(previous << 32 | t)
                        if fine if fine is not None else self._neighbours(previous, t):
                            fits = t
                            break
                    elif not at:
                        fits = t
                        break
                at -= 1
            last.append(fits)  # -1 only where no token border lies at the front of `held`

    def stream(self, data: Iterable[bytes]) -> Iterator[int]:
        """Token ids of a stream of bytes with no split points. Keeps ``lookahead`` + ``longest`` + two strides of bytes."""
        held, last, before = bytearray(), [], -1
        for block in data:
            for at in range(0, len(block), STRIDE):
                held += block[at:at + STRIDE]
                self._advance(held, last, before)
                if len(held) < self.lookahead + self.longest + STRIDE:
                    continue
                done = 0
                for t in self._back(last):
                    if done + len(self.tokens[t]) > len(held) - self.lookahead:
                        break
                    done += len(self.tokens[t])
                    before = t
                    yield t
                del held[:done], last[:done]
        yield from self._back(last)

    def _back(self, last: list[int]) -> list[int]:
        ids, n = [], len(last)
        while n:
            ids.append(last[n - 1])
            n -= len(self.tokens[last[n - 1]])
        return ids[::-1]

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = tuple(self.stream([piece.encode()]))
        if len(piece) <= 64:
            if len(self.young) >= PIECES:  # what was met since the last exchange is kept one more time
                self.old, self.young = self.young, {}
            self.young[piece] = ids
        return ids

    def chunks(self, text: str, size: int = CHUNK) -> Iterator[list[int]]:
        """Ids of a text, a list for every ``size`` characters or so: neither all split pieces nor all ids are held.

        No split piece holds white space behind another character, so a text may be
        cut in front of white space that follows one. Pieces met lately are looked
        up, others go through the transducer.
        """
        for i, part in enumerate(self.marks.split(text) if self.marks and self.marks.search(text) else (text,)):
            if i % 2:
                yield [self.special[part]]
                continue
            low = 0
            while low < len(part):
                cut = self.edge.search(part, low + size) if low + size < len(part) else None
                high = cut.start() if cut else len(part)
                out: list[int] = []
                for piece in self.split.findall(part, low, high):
                    out += self.young.get(piece) or self._piece(piece)
                yield out
                low = high

    def encode(self, text: str) -> array.array:
        """Ids of a whole text."""
        ids = array.array("I")
        for some in self.chunks(text):
            ids.extend(some)
        return ids

    def decoder(self) -> Callable[[Iterable[int], bool], str]:
        """A state machine from ids to text: the bytes of a character that is not complete wait for the next call.

        ``last`` ends the stream. An id that is null or not in the vocabulary becomes the replacement character.
        """
        machine, get = codecs.getincrementaldecoder("utf-8")("replace"), self.tokens.get
        return lambda ids, last=False: machine.decode(b"".join([get(i, UNKNOWN) for i in ids]), last)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text pieces of a stream of ids."""
        push, ids = self.decoder(), iter(ids)
        while block := list(islice(ids, 4096)):
            yield push(block)
        yield push([], True)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
_loaded: dict[str, Transducer] = {}


def _transducer(shipped: _Shipped) -> Transducer:
    """One transducer per worker process: tasks of a job share it and what it has seen."""
    if shipped.name not in _loaded:
        _loaded.clear()
        _loaded[shipped.name] = Transducer(shipped.held.value)
    return _loaded[shipped.name]


class _Shipped:
    """A broadcast vocabulary (a tokenizer file is of bounded size) and a name by which workers remember it."""

    def __init__(self, spark: SparkSession, vocabulary: Vocabulary):
        self.held = spark.sparkContext.broadcast(vocabulary)
        self.name = uuid.uuid4().hex


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id and ``ids``, the token ids of the whole text. Null reads as empty: no tokens."""
    shipped = _Shipped(df.sparkSession, vocabulary)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = _transducer(shipped)
        yield rows_batch(_IDS, [batch.column(0), [list(own.encode(t)) for t in batch.column(1).to_pylist()]])

    return map_batches(_texts(df, id_col, text_col), work, "doc_id long, ids array<long>").withColumnRenamed("doc_id", id_col)


def decode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: its id and ``text``. Null ids read as none; a null or unknown id in the list becomes the replacement character."""
    shipped = _Shipped(df.sparkSession, vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = _transducer(shipped)
        yield rows_batch(schema, [batch.column(0), ["".join(own.decode(ids or [])) for ids in batch.column(1).to_pylist()]])

    rows = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<bigint>").alias("ids"))
    return map_batches(rows, work, "doc_id long, text string").withColumnRenamed("doc_id", id_col)


def round_trip(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_tokens``, ``ids_sha256`` (ids as little-endian 32-bit words) and ``decoded_sha256`` of the text decoded again.

    Null reads as empty. Repeated rows come back as often as they went in; an
    empty table gives no rows. Only the two named columns are read.
    """
    shipped = _Shipped(df.sparkSession, vocabulary)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, counts, digests, texts = _transducer(shipped), [], [], []
        for text in batch.column(1).to_pylist():
            count, of_ids, of_text, push = 0, hashlib.sha256(), hashlib.sha256(), own.decoder()
            for ids in own.chunks(text):
                count += len(ids)
                of_ids.update(np.array(ids, "<u4").tobytes())
                of_text.update(push(ids).encode())
            of_text.update(push([], True).encode())
            counts.append(count)
            digests.append(of_ids.hexdigest())
            texts.append(of_text.hexdigest())
        yield rows_batch(_SCHEMA, [batch.column(0), counts, digests, texts])

    out = map_batches(_texts(df, id_col, text_col), work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("doc_id", id_col)
