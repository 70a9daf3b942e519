"""Personal data by rules and a character-level bidirectional LSTM with CRF transitions.

The base rules give exact spans. A tagger, trained here in numpy from labelled
spans, adds what the rules do not cover: numbers and addresses written in other
ways. It reads characters in overlapping windows; the windows' scores of every
character are weighed by how much context the window had there, and one Viterbi
pass over the whole stretch reconciles them, so no span depends on where a window
happened to end. Each kind has a tag for its first character and one for the
rest, and a rest can only follow its own kind, so neighbours stay apart.

Each of the four kinds holds a digit, an at sign or a spelled-out one. Stretches
of text further than a window's margin from any of these hold no span and are
not tagged; all others are, over whole texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brickledger.llm.support import map_batches, rows_batch

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# base rules

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that fails from the first digit of a run fails from the others too, so later starts are ruled out at once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(doubled) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            free = found.end()
            yield "email", start, free
        else:
            free = at + 1  # what is left of a lone at sign can belong to no later address
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start, then kind as listed."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGITS.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


# tagger

WINDOW, STEP, MARGIN = 96, 64, 48
TAGS = 2 * len(KINDS) + 1  # outside, then begin and inside of each kind
_SPOKEN = r"\b[A-Za-z0-9._%+-]+ at [A-Za-z0-9-]+(?: dot [A-Za-z0-9-]+)+\b"
TRIGGER = re.compile(r"[0-9@]|[(\[{] ?at ?[)\]}]|" + _SPOKEN, re.IGNORECASE)
#: Characters with a class of their own; the letters are those of a spelled-out at and dot.
_MARKS = " .-+()[]{}_%@:/,\n'\"=#atdo"
#: Added to the learned transitions: inside follows begin or inside of its own kind only.
LEGAL = np.zeros((TAGS, TAGS))
for _k in range(len(KINDS)):
    LEGAL[[t for t in range(TAGS) if (t + 1) // 2 != _k + 1], 2 * _k + 2] = -1e4
CLASSES = len(_MARKS) + 5


def char_classes(text: str) -> np.ndarray:
    """Class of each character: a mark of its own, digit, lower- or upper-case ASCII letter, other letter, anything else."""
    out = np.empty(len(text), np.int64)
    for i, c in enumerate(text):
        place = _MARKS.find(c)
        if place < 0:
            place = len(_MARKS) + (0 if "0" <= c <= "9" else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if c.isalpha() else 4)
        out[i] = place
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """Weights: per direction (inputs by class, recurrence, bias), output layer, transitions."""

    hidden: int = 16
    seed: int = 3
    w: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        if self.w:
            return
        rng, h = np.random.default_rng(self.seed), self.hidden
        for d in ("f", "b"):
            self.w[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * h))
            self.w[f"h{d}"] = rng.normal(0, 0.3 / np.sqrt(h), (h, 4 * h))
            self.w[f"c{d}"] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
        self.w |= {"o": rng.normal(0, 0.2, (2 * h, TAGS)), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}

    def _run(self, classes: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """One direction over (batch, time); the backward one is given reversed time."""
        n, steps, h = *classes.shape, self.hidden
        state, cell = np.zeros((n, h)), np.zeros((n, h))
        out, tape = np.empty((n, steps, h)), []
        for i in range(steps):
            z = self.w[f"x{d}"][classes[:, i]] + state @ self.w[f"h{d}"] + self.w[f"c{d}"]
            gates = _sigmoid(z[:, :3 * h])
            enter, keep, show, fresh = gates[:, :h], gates[:, h:2 * h], gates[:, 2 * h:], np.tanh(z[:, 3 * h:])
            before, old = cell, state
            cell = keep * before + enter * fresh
            squashed = np.tanh(cell)
            state = show * squashed
            out[:, i] = state
            tape.append((enter, keep, show, fresh, before, squashed, old))
        return out, tape

    def scores(self, classes: np.ndarray) -> np.ndarray:
        """Emission scores (batch, time, tags) of windows of character classes."""
        ahead, _ = self._run(classes, "f")
        back, _ = self._run(classes[:, ::-1], "b")
        return np.concatenate([ahead, back[:, ::-1]], axis=2) @ self.w["o"] + self.w["ob"]

    def _backprop(self, classes: np.ndarray, tape: list, slope: np.ndarray, d: str, grads: dict) -> None:
        h = self.hidden
        state, cell = np.zeros((len(classes), h)), np.zeros((len(classes), h))
        for i in range(classes.shape[1] - 1, -1, -1):
            enter, keep, show, fresh, before, squashed, old = tape[i]
            state = state + slope[:, i]
            cell = cell + state * show * (1 - squashed ** 2)
            z = np.concatenate([cell * fresh * enter * (1 - enter), cell * before * keep * (1 - keep),
                                state * squashed * show * (1 - show), cell * enter * (1 - fresh ** 2)], axis=1)
            np.add.at(grads[f"x{d}"], classes[:, i], z)
            grads[f"h{d}"] += old.T @ z
            grads[f"c{d}"] += z.sum(axis=0)
            state, cell = z @ self.w[f"h{d}"].T, cell * keep

    def gradient(self, classes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag sequences and its gradient."""
        n, steps, h = *classes.shape, self.hidden
        ahead, tape_f = self._run(classes, "f")
        back, tape_b = self._run(classes[:, ::-1], "b")
        both = np.concatenate([ahead, back[:, ::-1]], axis=2)
        score = both @ self.w["o"] + self.w["ob"]
        top = score.max(axis=2, keepdims=True)
        gain, move = np.exp(score - top), np.exp(self.w["t"] + LEGAL)
        alpha, beta, total = np.empty_like(gain), np.ones_like(gain), top.sum()
        alpha[:, 0] = gain[:, 0]
        for i in range(steps):
            if i:
                alpha[:, i] = (alpha[:, i - 1] @ move) * gain[:, i]
            size = alpha[:, i].sum(axis=1, keepdims=True)
            alpha[:, i] /= size
            total += np.log(size).sum()
        for i in range(steps - 2, -1, -1):
            beta[:, i] = (gain[:, i + 1] * beta[:, i + 1]) @ move.T
            beta[:, i] /= beta[:, i].sum(axis=1, keepdims=True)
        share = alpha * beta
        share /= share.sum(axis=2, keepdims=True)
        edge = alpha[:, :-1, :, None] * move * (gain[:, 1:] * beta[:, 1:])[:, :, None, :]
        edge /= edge.sum(axis=(2, 3), keepdims=True)
        true = np.eye(TAGS)[tags]
        want = (score * true).sum() + (self.w["t"] + LEGAL)[tags[:, :-1], tags[:, 1:]].sum()
        slope = (share - true) / n
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        grads["t"] = (edge.sum(axis=(0, 1)) - np.einsum("nsi,nsj->ij", true[:, :-1], true[:, 1:])) / n
        grads["o"], grads["ob"] = np.einsum("nsh,nst->ht", both, slope), slope.sum(axis=(0, 1))
        down = slope @ self.w["o"].T
        self._backprop(classes, tape_f, down[:, :, :h], "f", grads)
        self._backprop(classes[:, ::-1], tape_b, down[:, ::-1, h:], "b", grads)
        return (total - want) / n, grads

    def fit(self, examples: list[tuple[str, list[Span]]], rounds: int = 12, batch: int = 64, rate: float = 0.02) -> list[float]:
        """Adam on windows cut from labelled texts; the mean loss of each round."""
        classes, tags = [], []
        for text, spans in examples:
            tag = np.zeros(len(text), np.int64)
            for kind, start, end in spans:
                tag[start:end] = 2 * KINDS.index(kind) + 2
                tag[start] -= 1
            kinds = char_classes(text)
            for at in range(0, max(1, len(text) - WINDOW // 2), STEP):
                part, own = kinds[at:at + WINDOW], tag[at:at + WINDOW]
                classes.append(np.pad(part, (0, WINDOW - len(part))))
                tags.append(np.pad(own, (0, WINDOW - len(own))))
        x, y = np.array(classes), np.array(tags)
        rng, losses, step = np.random.default_rng(self.seed), [], 0
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for r in range(rounds):
            spent = []
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                loss, grads = self.gradient(x[part], y[part])
                spent.append(loss)
                step += 1
                size = np.sqrt(sum((g ** 2).sum() for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5 / size)
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] -= rate * (0.5 ** (r / 4)) * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)
            losses.append(float(np.mean(spent)))
        return losses

    def tag(self, text: str) -> np.ndarray:
        """Tags of a stretch: scores of overlapping windows averaged by their context, then one Viterbi pass over all."""
        kinds = char_classes(text)
        starts = [0] if len(text) <= WINDOW else [*range(0, len(text) - WINDOW, STEP), len(text) - WINDOW]
        total, weight = np.zeros((len(text), TAGS)), np.zeros((len(text), 1))
        trust = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1))[:, None].astype(float)
        for at in range(0, len(starts), 64):
            some = starts[at:at + 64]
            size = min(WINDOW, len(text))
            score = self.scores(np.stack([kinds[s:s + size] for s in some]))
            for s, part in zip(some, score):
                total[s:s + size] += part * trust[:size]
                weight[s:s + size] += trust[:size]
        emission, move = total / weight, self.w["t"] + LEGAL
        best, back = emission[0], np.zeros(emission.shape, np.int8)
        for i in range(1, len(emission)):
            ways = best[:, None] + move
            back[i] = ways.argmax(axis=0)
            best = ways.max(axis=0) + emission[i]
        out = np.empty(len(emission), np.int64)
        out[-1] = best.argmax()
        for i in range(len(emission) - 1, 0, -1):
            out[i - 1] = back[i][out[i]]
        return out


def stretches(text: str, triggers: list[int] | None = None) -> list[tuple[int, int]]:
    """Parts of a text within ``MARGIN`` characters of a trigger, joined where they touch."""
    out: list[tuple[int, int]] = []
    for at in triggers if triggers is not None else (m.start() for m in TRIGGER.finditer(text)):
        low, high = max(0, at - MARGIN), min(len(text), at + MARGIN)
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


_SPELLED = re.compile(r"[(\[{] ?at ?[)\]}]", re.IGNORECASE)
_SPELLED_OUT = re.compile(_SPOKEN, re.IGNORECASE)


def plausible(kind: str, text: str) -> bool:
    """What a tagged span must hold to be its kind, whatever way it is written."""
    digits = "".join(_DIGITS.findall(text))
    if kind == "email":
        marked = ("@" in text or bool(_SPELLED.search(text))) and "." in text.replace("(dot)", ".").replace("[dot]", ".")
        return marked or bool(_SPELLED_OUT.fullmatch(text))
    if kind == "ip":
        parts = [p for p in re.split(r"[^0-9]+", text) if p]
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .-]", text)
    return 9 <= len(digits) <= 15 and bool(re.search(r"[ ().-]", text)) and not re.search(r"[^0-9 ()+./-]", text)


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in " .,;:\n":
        a += 1
    while b > a and text[b - 1] in " .,;:\n":
        b -= 1
    return a, b


def pieces(kind: str, text: str) -> list[tuple[int, int]]:
    """Plausible spans of a kind in a tagged run that is none as a whole, from left to right, cut at blanks and commas.

    Of the pieces that start at a word, cards take the one nearest to 16 digits, other kinds the shortest.
    """
    words = [m.span() for m in re.finditer(r"[^\s,;]+", text)]
    out, i = [], 0
    while i < len(words):
        found = []
        for j in range(i, min(len(words), i + 8)):
            a, b = _trimmed(text, words[i][0], words[j][1])
            if a < b and plausible(kind, text[a:b]):
                found.append((abs(len(_DIGITS.findall(text[a:b])) - 16) if kind == "card" else 0, j, a, b))
        if found:
            _, j, a, b = min(found)
            out.append((a, b))
            i = j
        i += 1
    return out


def tagged_runs(tags: np.ndarray) -> list[tuple[str, list[tuple[int, int]]]]:
    """Spans of the tags by run: spans of one kind that touch, or are parted by up to two characters, belong together."""
    runs: list[tuple[str, list[tuple[int, int]]]] = []
    kinds = (tags + 1) // 2
    edges = np.flatnonzero((np.diff(kinds) != 0) | ((tags[1:] % 2 == 1) & (kinds[1:] > 0))) + 1
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(tags)]):
        if not kinds[start]:
            continue
        kind = KINDS[kinds[start] - 1]
        if runs and runs[-1][0] == kind and start - runs[-1][1][-1][1] <= 2:
            runs[-1][1].append((start, end))
        else:
            runs.append((kind, [(start, end)]))
    return runs


def added_spans(text: str, tagger: Tagger, base: list[Span]) -> list[Span]:
    """Tagged spans that are plausible, stand apart from letters and digits, and meet no base span.

    A run with a span that is not plausible is cut anew, so neighbours are found
    although the tagger took them for one.
    """
    out: list[Span] = []
    taken = [(s, e) for _, s, e in base]
    for low, high in stretches(text):
        for kind, spans in tagged_runs(tagger.tag(text[low:high])):
            cut = [_trimmed(text, low + a, low + b) for a, b in spans]
            cut = [(a, b) for a, b in cut if a < b]
            if not all(plausible(kind, text[a:b]) for a, b in cut):
                first, last = cut[0][0], cut[-1][1]
                cut = [(first + a, first + b) for a, b in pieces(kind, text[first:last])]
            for a, b in cut:
                alone = not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b].isalnum() and text[b - 1].isalnum())
                if alone and not any(s < b and a < e for s, e in taken):
                    out.append((kind, a, b))
                    taken.append((a, b))
    return out


def labelled_spans(count: int = 900, seed: int = 17) -> list[tuple[str, list[Span]]]:
    """Labelled texts for training: each kind in the ways people write it, amid words and numbers that are no personal data."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[int(rng.integers(len(options)))]
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 10))))

    def email() -> str:
        name, place = pick(word(), f"{word()}.{digits(2)}", f"{word()}_{word()}"), f"{word()}{pick('', digits(1))}"
        top = pick("com", "org", "example.com", "co.uk", "net")
        return pick(f"{name}@{place}.{top}", f"{name}@{place}.{top}", f"{name} (at) {place} (dot) {top}", f"{name}[at]{place}.{top}",
                    *[f"{name} at {place} dot {pick('com', 'org', 'net', 'co dot uk')}"] * 2)

    def ip() -> str:
        parts = [str(int(rng.integers(0, 256))) for _ in range(4)]
        return pick(".".join(parts), ".".join(parts), "[.]".join(parts))

    def card() -> str:
        body = digits(15)
        full = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return pick(full, full, " ".join(full[i:i + 4] for i in range(0, 16, 4)), "-".join(full[i:i + 4] for i in range(0, 16, 4)),
                    ".".join(full[i:i + 4] for i in range(0, 16, 4)))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"+{digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)}-{a}-{b}-{c}")

    def other() -> str:
        return pick(f"{digits(1)}.{digits(1)}.", f"version {digits(1)}.{digits(1)}.{digits(2)}", digits(int(rng.integers(1, 9))), f"{digits(4)}-{digits(2)}-{digits(2)}",
                    f"key={word()}{digits(4)}{word()}{digits(9)}", f"\"{digits(3)}{word()}{digits(5)}{word()}{digits(8)}\"", f"{word()}{digits(2)}{word()}", f"@{word()}",
                    f"{digits(2)}:{digits(2)}", f"£{digits(3)},{digits(3)}", f"({digits(4)})", f"{digits(20)}", f"{digits(2)}%", f"#{digits(5)}", f"({word()} at {word()})", f"{word()} at {word()} {word()}", f"dot {word()} at")

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(int(rng.integers(8, 22))):
            draw = rng.random()
            if draw < 0.16:
                kind = KINDS[int(rng.integers(len(KINDS)))]
                made = makers[kind]()
                for again in range(pick(0, 0, 1, 2)):  # neighbours of one kind, the same or another
                    spans.append((kind, len(text), len(text) + len(made)))
                    text += made + pick(" ", " ", ", ", "\n")
                    made = pick(made, makers[kind]())
                spans.append((kind, len(text), len(text) + len(made)))
            else:
                made = other() if draw < 0.3 else pick(word(), word(), word().capitalize())
            text += made + pick(" ", " ", " ", ", ", ". ", "\n")
        out.append((text, spans))
    return out


_trained: dict[int, Tagger] = {}


def trained_tagger(count: int = 900) -> Tagger:
    """The tagger fitted on ``labelled_spans``; always the same, so it is fitted once per driver process."""
    if count not in _trained:
        tagger = Tagger()
        tagger.fit(labelled_spans(count))
        _trained[count] = tagger
    return _trained[count]


_SCHEMA = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
_SQL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(df: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of base spans by kind, digest of the base spans, and ``spans``: base and added ones, joined.

    A span is ``kind:start:end`` in code points, end exclusive; spans go by start,
    then kind. Null and empty texts have none. Repeated rows come back as often
    as they went in; an empty table gives no rows. Only the two columns are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(tagger)  # a few thousand weights

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            base = base_spans(text)
            more = added_spans(text, shared.value, base) if TRIGGER.search(text) else []
            spans = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
            counts = [sum(s[0] == k for s in base) for k in KINDS]
            rows.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        yield rows_batch(_SCHEMA, list(map(list, zip(*rows))))

    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return map_batches(texts, work, _SQL).withColumnRenamed("doc_id", id_col)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans are replaced together, under the first one's kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])
