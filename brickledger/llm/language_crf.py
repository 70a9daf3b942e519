"""Language identification by a linear-chain conditional random field over words.

Every word has affix, character n-gram and lexicon features whose weights add up
to a score per language; learned transitions couple neighbouring words. Forward-
backward labels every word with a distribution over languages, so text that
switches between languages is labelled piece by piece, and a document's language
is the one with most of the probability over its words.

The field is fitted on the driver from a bounded sample of labelled rows.
Prediction runs in tasks over whole texts: the texts of a batch form one chain in
which the first word of a text forgets what came before it, and the chain is
evaluated in blocks by products of small matrices, exactly.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from brickledger.llm.support import map_batches, rows_batch

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
BUCKETS = 1 << 15
SAMPLE_PER_LANGUAGE = 128
SAMPLE_CHARS = 20_000
LEXICON = 200
CACHE = 150_000
CACHE_CHARS = 4_000_000
GRAMS = 200_000
CHAIN = 400_000
BLOCK = 64
#: Characters of words whose grams are hashed side by side; a word with more of them is read by ``features``.
HASHED_CHARS = 200_000
#: Mean probability of each word's best language below which a text is in none of the learned ones, see ``accepted``.
LEAST_CERTAINTY = 0.75


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case. The pattern also takes numerals such as ½ or Ⅷ, which ASCII lacks: runs without any letter go."""
    words = WORD.findall(text.lower())
    return words if text.isascii() else [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


def features(word: str, lexicon: dict[str, int], numbers: dict[str, int]) -> list[int]:
    """Ids of a word's features: marked prefixes and suffixes, 2- and 3-grams, and its place in the lexicon if it has one.

    Grams are those of the entire word: text without blanks is one word, however long. All but the last are hashed; ``numbers`` remembers hashes.
    """
    marked = f"^{word}$"
    size = len(marked)
    found = {marked[:2], marked[:3], marked[:4] + "+", "+" + marked[-4:]}
    found.update([marked[i:i + 2] for i in range(size - 1)])
    found.update([marked[i:i + 3] for i in range(size - 2)])
    found.add(marked[-3:])
    ids = []
    for x in found:
        number = numbers.get(x)
        if number is None:
            if len(numbers) >= GRAMS:
                numbers.clear()
            number = numbers[x] = zlib.crc32(x.encode()) % BUCKETS
        ids.append(number)
    ids.sort()  # sums do not depend on the order in which a set is read
    known = lexicon.get(word)
    if known is not None:
        ids.append(BUCKETS + known)
    return ids


def _checksum_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CHECKSUMS = _checksum_table()


def _step(state: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """CRC-32 states one byte further."""
    return _CHECKSUMS[(state ^ byte) & 0xFF] ^ (state >> 8)


def _checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, ahead: str = "", behind: str = "") -> np.ndarray:
    """CRC-32 of each ``data[start:end]``, with an ASCII character before and behind it if given."""
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    if ahead:
        state = _step(state, np.uint32(ord(ahead)))
    size = end - start
    least = int(size.min())
    for at in range(least):
        state = _step(state, data[start + at])
    for at in range(least, int(size.max())):  # characters of more than one byte
        left = np.flatnonzero(size > at)
        state[left] = _step(state[left], data[start[left] + at])
    if behind:
        state = _step(state, np.uint32(ord(behind)))
    return state ^ np.uint32(0xFFFFFFFF)


def features_of(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """``features`` of many words at once: their ids one after another, and where each word's begin.

    All grams are hashed side by side. Grams of one length in one word are told apart by their CRC-32.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    data = np.frombuffer(("^" + "$^".join(words) + "$").encode(), np.uint8).astype(np.uint32)
    chars = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where characters begin
    ends = np.cumsum(lengths)
    starts = ends - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(int(ends[-1]))  # characters from here to the word's end
    keys = []
    for size in (2, 3):
        at = np.flatnonzero(left >= size)
        found = _checksums(data, chars[at], chars[at + size])
        keys.append((owner[at] << 33) | ((found.astype(np.int64) & (BUCKETS - 1)) << 18) | ((found >> 15).astype(np.int64) << 1) | (size == 3))
    grams = np.sort(np.concatenate(keys))
    grams = grams[np.append(True, grams[1:] != grams[:-1])]
    # the ends of a word, marked by + on their inner side, are no other gram: a word holds letters only
    several = np.arange(len(words))
    whole = np.minimum(lengths, 4)
    edges = [_checksums(data, chars[starts], chars[starts + whole], behind="+"), _checksums(data, chars[ends - whole], chars[ends], ahead="+")]
    known = [(i, BUCKETS + lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    found = [((grams >> 33) << 32) | ((grams >> 18) & (BUCKETS - 1)), *[(several << 32) | (e & np.uint32(BUCKETS - 1)) for e in edges],
             np.array([(i << 32) | z for i, z in known], np.int64)]
    ids = np.sort(np.concatenate(found))
    return ids & 0xFFFFFFFF, np.searchsorted(ids, several << 32)


@dataclass
class Field:
    """A fitted field: ``weights`` by feature and language, ``start`` and ``step`` as log scores."""

    languages: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    start: np.ndarray
    step: np.ndarray

    def emission(self, words: list[str], numbers: dict[str, int]) -> np.ndarray:
        """Scores by word and language; capped so that no single word can outweigh a text."""
        scores = np.empty((len(words), len(self.languages)))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(sizes > HASHED_CHARS).tolist()
        for i in long:
            scores[i] = self.weights[features(words[i], self.lexicon, numbers)].sum(axis=0)
        short = np.flatnonzero(sizes <= HASHED_CHARS)
        total = np.cumsum(sizes[short])
        for part in np.split(short, np.flatnonzero(np.diff(total // HASHED_CHARS)) + 1):
            if len(part):
                flat, starts = features_of([words[i] for i in part.tolist()], self.lexicon)
                scores[part] = np.add.reduceat(self.weights[flat], starts, axis=0)
        return np.clip(scores, -12, 12)


def _most(values: np.ndarray) -> np.ndarray:
    """The largest of each row, column by column: rows are short."""
    return reduce(np.maximum, values.T)


def _total(values: np.ndarray) -> np.ndarray:
    return reduce(np.add, values.T)


def marginals(emission: np.ndarray, first: np.ndarray, field: Field, block: int = BLOCK) -> np.ndarray:
    """Forward-backward over one chain of texts: P(language of word) per word.

    ``emission`` is (words, languages) in log scores, ``first`` marks the first
    word of each text. The chain is laid out as rows of ``block`` words. Each row
    is first reduced to the product of its step matrices, the rows are then
    linked one after the other, and last every row is run from its true ends.
    """
    n, k = emission.shape
    rows = -(-n // block)
    gain = np.ones((rows * block, k))
    gain[:n] = np.exp(emission - _most(emission)[:, None])
    reset = np.zeros(rows * block, bool)
    reset[:n], reset[n:] = first, True
    gain, reset = gain.reshape(rows, block, k), reset.reshape(rows, block)
    fresh = [np.flatnonzero(reset[:, i]) for i in range(block)]  # rows that begin a text at a place
    step, start = np.exp(field.step), np.exp(field.start)
    # forward: what a row does to whatever comes in
    through = np.broadcast_to(np.eye(k), (rows, k, k)).copy()
    for i in range(block):
        moved = (through.reshape(-1, k) @ step).reshape(rows, k, k)
        moved[fresh[i]] = through[fresh[i]].sum(axis=2, keepdims=True) * start
        through = moved * gain[:, i, None, :]
        through /= _most(through.reshape(rows, k * k))[:, None, None]
    into, out = np.empty((rows, k)), np.empty((rows, k))
    state = np.full(k, 1 / k)
    for r in range(rows):
        into[r] = state
        state = state @ through[r]
        state /= state.sum()
    state = np.ones(k)
    for r in range(rows - 1, -1, -1):
        out[r] = state
        state = through[r] @ state
        state /= state.sum()
    alpha = np.empty((rows, block, k))
    state = into
    for i in range(block):
        state = state @ step
        state[fresh[i]] = start
        state *= gain[:, i]
        state /= _total(state)[:, None]
        alpha[:, i] = state
    state = out
    for i in range(block - 1, -1, -1):
        alpha[:, i] *= state
        ahead = gain[:, i] * state
        state = ahead @ step.T
        state[fresh[i]] = (ahead[fresh[i]] @ start)[:, None]
        state /= _total(state)[:, None]
    flat = alpha.reshape(-1, k)[:n]
    return flat / _total(flat)[:, None]


def fit(samples: dict[str, list[str]], seed: int = 5, sequences: int = 1500, length: int = 40, rounds: int = 8) -> Field:
    """Fit from texts by language: gradient steps on the likelihood of word labels.

    Training chains are spliced from runs of 4 to 20 words of random languages, so
    transitions are learned from text that switches. The result depends on the
    samples and the seed only.
    """
    languages = sorted(samples)
    streams = {x: [w for t in sorted(samples[x]) for w in words_of(t)] for x in languages}
    languages = [x for x in languages if streams[x]]
    if not languages:
        return Field([], {}, np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros((0, 0)))
    k, rng = len(languages), np.random.default_rng(seed)
    frequent = {w for x in languages for w, _ in sorted(Counter(streams[x]).items(), key=lambda p: (-p[1], p[0]))[:LEXICON]}
    lexicon = {w: i for i, w in enumerate(sorted(frequent))}
    spliced, labels = [], np.empty((sequences, length), int)
    for s in range(sequences):
        words: list[str] = []
        while len(words) < length:
            z = int(rng.integers(k))
            run = min(int(rng.integers(4, 21)), length - len(words))
            stream = streams[languages[z]]
            at = int(rng.integers(max(1, len(stream) - run)))
            piece = [stream[(at + i) % len(stream)] for i in range(run)]
            labels[s, len(words):len(words) + run] = z
            words += piece
        spliced.append(words)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for c in spliced for w in c))}
    numbers: dict[str, int] = {}
    known = [features(w, lexicon, numbers) for w in vocabulary]
    owner = np.repeat(np.arange(len(known)), [len(f) for f in known])
    flat = np.concatenate([np.array(f) for f in known])
    ids = np.array([[vocabulary[w] for w in c] for c in spliced])
    field = Field(languages, lexicon, np.zeros((BUCKETS + len(lexicon), k)), np.zeros(k), np.zeros((k, k)))
    past = [np.full_like(x, 1e-6) for x in (field.weights, field.start, field.step)]
    once = np.eye(k)
    for _ in range(rounds):
        for part in np.array_split(rng.permutation(sequences), 12):
            scores = np.zeros((len(known), k))
            np.add.at(scores, owner, field.weights[flat])
            seen, want = ids[part], labels[part]
            alpha, beta = np.empty((length, len(part), k)), np.empty((length, len(part), k))
            gain = np.exp(scores[seen] - scores[seen].max(axis=2, keepdims=True)).transpose(1, 0, 2)
            step = np.exp(field.step)
            alpha[0] = np.exp(field.start) * gain[0]
            alpha[0] /= alpha[0].sum(axis=1, keepdims=True)
            for t in range(1, length):
                alpha[t] = (alpha[t - 1] @ step) * gain[t]
                alpha[t] /= alpha[t].sum(axis=1, keepdims=True)
            beta[-1] = 1
            for t in range(length - 2, -1, -1):
                beta[t] = (gain[t + 1] * beta[t + 1]) @ step.T
                beta[t] /= beta[t].sum(axis=1, keepdims=True)
            share = alpha * beta
            share /= share.sum(axis=2, keepdims=True)
            edge = alpha[:-1, :, :, None] * step * (gain[1:] * beta[1:])[:, :, None, :]
            edge /= edge.sum(axis=(2, 3), keepdims=True)
            true = once[want].transpose(1, 0, 2)
            miss = np.zeros_like(scores)
            np.add.at(miss, seen.T.ravel(), (true - share).reshape(-1, k))
            slope = np.zeros_like(field.weights)
            np.add.at(slope, flat, miss[owner])
            moves = (slope / len(part) - 1e-4 * field.weights, (true[0] - share[0]).mean(axis=0),
                     (np.einsum("tbi,tbj->ij", true[:-1], true[1:]) - edge.sum(axis=(0, 1))) / len(part) - 1e-3 * field.step)
            for value, move, square in zip((field.weights, field.start, field.step), moves, past):
                square += move * move
                value += 0.3 * move / np.sqrt(square)
    return field


def training_sample(df: DataFrame, id_col: str, text_col: str, label_col: str, per_language: int = SAMPLE_PER_LANGUAGE,
                    chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """At most ``per_language`` whole texts of each label, texts of up to ``chars`` characters preferred.

    Each label's rows are dealt into ``per_language`` salts by a hash of the id;
    the smallest hash of each salt is taken, so minima combine before the
    shuffle and no label meets in one task. What reaches the driver is bounded by
    the parameter times the number of labels (texts above ``chars`` are read only
    from labels that have too few others).
    """
    key = F.xxhash64(F.lit("sample"), F.col(id_col).cast("string"))
    salt = F.pmod(F.xxhash64(F.lit("salt"), F.col(id_col).cast("string")), F.lit(per_language))
    rank = F.shiftrightunsigned(key, 2) + F.when(F.length(text_col) > chars, F.lit(1 << 62)).otherwise(F.lit(0))
    rows = df.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(label_col).alias("label"), F.col(text_col).alias("text"), salt.alias("salt"), rank.alias("rank"))
    # per_language rows for each label: bounded by the parameter
    chosen = rows.groupBy("label", "salt").agg(F.min("rank").alias("rank"))
    best = Window.partitionBy("label").orderBy("rank")
    chosen = chosen.withColumn("has_short", F.min("rank").over(best) < F.lit(1 << 62)).where(
        ~F.col("has_short") | (F.col("rank") < F.lit(1 << 62)))
    out: dict[str, list[str]] = {}
    # `chosen` has per_language rows for each label: safe to broadcast, and the texts are not shuffled
    picked = rows.join(F.broadcast(chosen.select("label", "salt", "rank")), ["label", "salt", "rank"]).groupBy("label", "salt").agg(
        F.min("text").alias("text"))
    for r in picked.collect():
        out.setdefault(r.label, []).append(r.text)
    return out


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("n_words", pa.int64()),
                     ("n_switches", pa.int64()), ("certainty", pa.float64())])


class Labeller:
    """Scores batches of texts; words already seen by this task are scored once."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, int] = {}
        self.chars = 0
        self.numbers: dict[str, int] = {}
        self.scores = np.zeros((1024, len(field.languages)))

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE or self.chars > CACHE_CHARS:
            self.known.clear()
            self.chars = 0
        known = self.known
        new = list(set(words).difference(known))
        for at in range(0, len(new), 20_000):
            some = new[at:at + 20_000]
            start = len(known)
            known.update(zip(some, range(start, start + len(some))))
            self.chars += sum(map(len, some))
            while len(known) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[start:len(known)] = self.field.emission(some, self.numbers)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str | None]) -> list[tuple[str, float, int, int, float]]:
        """(language, score, words, switches, certainty) per text; chains of bounded length are evaluated at a time."""
        out: list[tuple[str, float, int, int, float]] = []
        held: list[list[str]] = []
        size = 0
        for text in texts:
            words = words_of(text) if text else []
            held.append(words)
            size += len(words)
            if size >= CHAIN:
                out += self._chain(held)
                held, size = [], 0
        return out + self._chain(held) if held else out

    def _chain(self, texts: list[list[str]]) -> list[tuple[str, float, int, int, float]]:
        counts = np.array([len(t) for t in texts])
        total = int(counts.sum())
        if not total or not self.field.languages:
            return [(UNKNOWN, 0.0, int(c), 0, 0.0) for c in counts]
        ids = self._ids([w for t in texts for w in t])
        emission = self.scores[ids]
        ends = np.cumsum(counts)
        starts = (ends - counts)[counts > 0]
        first = np.zeros(total, bool)
        first[starts] = True
        share = marginals(emission, first, self.field)
        sums = np.add.reduceat(share, starts, axis=0)
        best = share.argmax(axis=1)
        sure = np.add.reduceat(_most(share), starts)
        change = np.concatenate([[0], best[1:] != best[:-1]]).astype(np.int64)
        change[starts] = 0
        switches = np.add.reduceat(change, starts)
        rows = iter(range(len(starts)))
        out = []
        for c in counts:
            if not c:
                out.append((UNKNOWN, 0.0, 0, 0, 0.0))
                continue
            r = next(rows)
            z = int(sums[r].argmax())
            # one certain word is added: a single doubtful word is no evidence yet
            out.append((self.field.languages[z], float(min(1.0, max(0.0, sums[r, z] / c))), int(c), int(switches[r]),
                        float((sure[r] + 1) / (c + 1))))
        return out


def predict(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``lang_pred``, ``score`` (mean probability of that language over the words), ``n_words``, ``n_switches``, ``certainty``.

    ``certainty`` is the mean probability of each word's own best language, one certain word added.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned. Repeated rows come back as often as they went in; an empty table
    gives no rows. Only the two named columns are read.
    """
    model = df.sparkSession.sparkContext.broadcast(field)  # bounded by BUCKETS, LEXICON and the number of labels
    labeller: list[Labeller] = []

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not labeller:
            labeller.append(Labeller(model.value))
        found = labeller[0].label(batch.column(1).to_pylist())
        yield rows_batch(_SCHEMA, [batch.column(0), *map(list, zip(*found))])

    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_batches(texts, work, "doc_id long, lang_pred string, score double, n_words long, n_switches long, certainty double")
    return out.withColumnRenamed("doc_id", id_col)


def held_out(id_col: str = "doc_id"):
    """Rows set aside for measuring: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Fit on the labelled rows that are not held out, predict every row."""
    field = fit(training_sample(df.where(~held_out(id_col)), id_col, text_col, label_col))
    return predict(df, field, id_col, text_col)


def accepted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
             least_certainty: float = LEAST_CERTAINTY) -> DataFrame:
    """The rows, with all their columns, that are written in the learned languages.

    A text goes if it is ``und`` or if its words, taken one by one, belong to no
    language with enough probability: text in an unlearned script or language and
    letter noise leave the field undecided at most words. Text that switches
    between learned languages is certain word by word and stays. The text travels
    with its row through the labeller, so there is no join.
    """
    field = fit(training_sample(df.where(~held_out(id_col)), id_col, text_col, label_col))
    model = df.sparkSession.sparkContext.broadcast(field)
    at, labeller = df.columns.index(text_col), []

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not labeller:
            labeller.append(Labeller(model.value))
        found = labeller[0].label(batch.column(at).to_pylist())
        yield batch.filter(pa.array([name != UNKNOWN and sure >= least_certainty for name, *_, sure in found], pa.bool_()))

    return map_batches(df, work, df.schema)
