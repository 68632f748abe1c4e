"""Personal data: exact patterns, and a linear-chain CRF for what they miss.

The patterns give the base spans. The sequence model reads tokens by their shape
(letters, digits and marks reduced to classes), their neighbours' shapes and a
few telling words, learns its weights from a small labelled table by the exact
gradient of the likelihood, and is decoded by Viterbi on batches of sequences in
numpy. Its spans are added where they pass the kind's plausibility test and do
not touch a base span.

No kind can do without a digit or a word for the at sign, so sequences are the
stretches of text around those, ``REACH`` tokens each side; all of a text's
stretches are read. Long stretches are cut at ``LONGEST`` tokens, with
``REACH`` tokens of the neighbours on both sides as context, so a span is at most
that much longer than what is cut, and one that begins before a cut is followed
across it for ``REACH`` tokens. Added e-mails are under 320 characters, the longest
an address can be.

Everything happens inside a row, so there is no shuffle and no hot key.

Defined results: a null or empty text has no spans; repeated rows and null ids
come out each; an empty table gives no rows; offsets are in code points, the end
exclusive; a run of digits or letters of any length is read in linear time, as is
any number of spans; other columns are not looked at, and masking keeps them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidefold.llm.common import whole_batches
from tidefold.llm.pii_examples import EXAMPLES

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{part}-{kind}" for kind in KINDS for part in "BI"))
REACH = 8
LONGEST = 256
EPOCHS = 200
RATE = 0.1
PENALTY = 1e-3
BLOCK_BYTES = 8 << 20
# Cells (sequences times tokens) that are decoded together.
TOGETHER = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is taken whole or not at all, so a later start in it finds nothing new.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|[\d_]")
_TELLING = re.compile(r"[0-9@]|\b(?:at|AT|dot|DOT)\b")
_DIGITS = re.compile(r"[^0-9]+")
_WRITTEN_OUT = re.compile(
    r"[\w.%+-]+(?:[\x20]?(?:[(\[]dot[)\]]|\bdot\b)[\x20]?[\w.%+-]+)*(?:@[\w-]+(?:\.[\w-]+)*"
    r"|[\x20]?(?:[(\[]at[)\]]|\bat\b)[\x20]?[\w-]+(?:(?:\.|[\x20]?(?:[(\[]dot[)\]]|\bdot\b)[\x20]?)[\w-]+)+)",
    re.IGNORECASE,
)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Spans of the exact patterns, by kind and then start."""
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m[0]) if m.end() - m.start() < 64 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                found.append(("phone", *m.span()))
    return found


def spans_text(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda span: (KINDS.index(span[0]), span[1]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in order)


# Words that tell what a number beside them is.
WORDS = {
    "at": "at", "dot": "dot", "tel": "call", "phone": "call", "telephone": "call", "call": "call", "fax": "call",
    "mobile": "call", "ring": "call", "number": "call", "cell": "call", "handy": "call", "dial": "call", "desk": "call",
    "mail": "mail", "email": "mail", "address": "mail", "contact": "mail", "write": "mail", "card": "card", "visa": "card", "isbn": "book",
    "version": "version", "token": "secret", "password": "secret", "key": "secret", "commit": "secret", "sha": "secret",
}


def shape(token: str) -> str:
    """What the model sees of a token."""
    if token.isdigit():
        return f"9x{min(len(token), 20)}"
    if token.isalpha():
        word = WORDS.get(token.lower())
        return word or ("A" if token.isupper() else "Aa" if token[0].isupper() else "a") + ("1" if len(token) == 1 else "")
    return token


class Crf:
    """Linear chain over shape features; weights per (place, shape, label)."""

    OFFSETS = (-2, -1, 0, 1, 2)

    def __init__(self, shapes: list[str]):
        # The last but one shape is any unseen, the last stands beyond the ends.
        self.shapes = {s: i for i, s in enumerate(shapes)}
        self.unseen, self.beyond = len(shapes), len(shapes) + 1
        self.emit = np.zeros((len(self.OFFSETS), len(shapes) + 2, len(LABELS)))
        # Whether white space parts a token from the one before: per label.
        self.parted = np.zeros((2, len(LABELS)))
        self.move = np.zeros((len(LABELS), len(LABELS)))
        self.allowed = np.zeros_like(self.move)
        for j, to in enumerate(LABELS):
            if to[0] == "I":
                kind = to[2:]
                for i, of in enumerate(LABELS):
                    if of not in (f"B-{kind}", f"I-{kind}"):
                        self.allowed[i, j] = -1e4
        self.begin = np.array([-1e4 if label[0] == "I" else 0.0 for label in LABELS])

    def padded(self, rows: list[tuple[list[str], list[bool]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shape ids per offset (offset, rows, tokens), gaps, and lengths."""
        sizes = np.array([len(tokens) for tokens, _ in rows])
        width = int(sizes.max())
        ids = np.full((len(rows), width + 4), self.beyond)
        gaps = np.zeros((len(rows), width), np.int64)
        for i, (tokens, parted) in enumerate(rows):
            ids[i, 2 : 2 + len(tokens)] = [self.shapes.get(s, self.unseen) for s in map(shape, tokens)]
            gaps[i, : len(tokens)] = parted
        return np.stack([ids[:, 2 + o : 2 + o + width] for o in self.OFFSETS]), gaps, sizes

    def emissions(self, ids: np.ndarray, gaps: np.ndarray) -> np.ndarray:
        return sum(self.emit[k][ids[k]] for k in range(len(self.OFFSETS))) + self.parted[gaps]

    def fit(self, rows, labels: list[list[int]], epochs: int = EPOCHS) -> None:
        """Maximise the penalised likelihood by full-batch gradient steps (Adam)."""
        ids, gaps, sizes = self.padded(rows)
        n, width = gaps.shape
        inside = np.arange(width) < sizes[:, None]
        gold = np.zeros((n, width, len(LABELS)))
        moved = np.zeros_like(self.move)
        for i, own in enumerate(labels):
            gold[i, np.arange(len(own)), own] = 1
            np.add.at(moved, (own[:-1], own[1:]), 1)
        weights = [self.emit, self.parted, self.move]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for epoch in range(1, epochs + 1):
            score = self.emissions(ids, gaps)
            move = self.move + self.allowed
            ahead, behind = np.empty_like(score), np.zeros_like(score)
            ahead[:, 0] = score[:, 0] + self.begin
            for t in range(1, width):
                step = _log_sum(ahead[:, t - 1, :, None] + move, 1) + score[:, t]
                ahead[:, t] = np.where(inside[:, t, None], step, ahead[:, t - 1])
            total = _log_sum(ahead[:, -1], 1)
            for t in range(width - 2, -1, -1):
                step = _log_sum(move + (score[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
                behind[:, t] = np.where(inside[:, t + 1, None], step, 0)
            share = np.exp(ahead + behind - total[:, None, None]) * inside[:, :, None]
            pairs = np.zeros_like(self.move)
            for t in range(1, width):
                own = inside[:, t]
                joint = ahead[own, t - 1, :, None] + move + (score[own, t] + behind[own, t])[:, None, :]
                pairs += np.exp(joint - total[own, None, None]).sum(0)
            rest = (gold - share) * inside[:, :, None]
            up = np.zeros_like(self.emit)
            for k in range(len(self.OFFSETS)):
                np.add.at(up[k], ids[k], rest)
            parted = np.zeros_like(self.parted)
            np.add.at(parted, gaps, rest)
            for k, (w, g) in enumerate(zip(weights, (up, parted, moved - pairs))):
                g = g / n - PENALTY * w
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = RATE * np.sqrt(1 - 0.999**epoch) / (1 - 0.9**epoch)
                w += rate * first[k] / (np.sqrt(second[k]) + 1e-8)

    def decode(self, rows) -> list[np.ndarray]:
        """The best labels of each sequence, decoded in batches of like length."""
        order = sorted(range(len(rows)), key=lambda i: len(rows[i][0]))
        best: list[np.ndarray] = [np.zeros(0, np.int64)] * len(rows)
        batch: list[int] = []
        for i in order + [-1]:
            if batch and (i < 0 or len(rows[i][0]) * (len(batch) + 1) > TOGETHER):
                for j, labels in zip(batch, self._viterbi([rows[j] for j in batch])):
                    best[j] = labels
                batch = []
            if i >= 0 and rows[i][0]:
                batch.append(i)
        return best

    def _viterbi(self, rows) -> Iterator[np.ndarray]:
        ids, gaps, sizes = self.padded(rows)
        score, move = self.emissions(ids, gaps), self.move + self.allowed
        n, width = gaps.shape
        back = np.zeros((width, n, len(LABELS)), np.int8)
        ends = np.empty((n, len(LABELS)))
        now = score[:, 0] + self.begin
        for t in range(width):
            if t:
                steps = now[:, :, None] + move
                back[t] = steps.argmax(1)
                now = steps.max(1) + score[:, t]
            ended = sizes == t + 1
            ends[ended] = now[ended]
        labels = np.zeros((n, width), np.int64)
        at = ends.argmax(1)
        every = np.arange(n)
        for t in range(width - 1, -1, -1):
            live = sizes > t
            labels[live, t] = at[live]
            if t:
                at = np.where(live, back[t][every, at], at)
        return (labels[i, : sizes[i]] for i in range(n))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def labelled(line: str) -> tuple[str, list[Span]]:
    """A line of the table without its marks, and the spans they gave."""
    text, spans = "", []
    for i, part in enumerate(re.split(r"\[((?:email|ip|card|phone):(?:\[(?:at|dot)\]|[^\]])*)\]", line)):
        if i % 2:
            kind, _, part = part.partition(":")
            spans.append((kind, len(text), len(text) + len(part)))
        text += part
    return text, spans


def tokens_of(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def _features(text: str, places: list[tuple[int, int]]) -> tuple[list[str], list[bool]]:
    parted = [i == 0 or places[i - 1][1] < a for i, (a, _) in enumerate(places)]
    return [text[a:b] for a, b in places], parted


def train(lines: list[str] = EXAMPLES, epochs: int = EPOCHS) -> Crf:
    rows, labels = [], []
    for line in lines:
        text, spans = labelled(line)
        places = tokens_of(text)
        rows.append(_features(text, places))
        own = [0] * len(places)
        for kind, a, b in spans:
            for i, (x, y) in enumerate(places):
                if a <= x and y <= b:
                    own[i] = LABELS.index(f"{'B' if x == a else 'I'}-{kind}")
        labels.append(own)
    seen = defaultdict(int)
    for tokens, _ in rows:
        for token in tokens:
            seen[shape(token)] += 1
    model = Crf(sorted(seen))
    model.fit(rows, labels, epochs)
    return model


def stretches(text: str) -> list[tuple[list[tuple[int, int]], int, int]]:
    """Token places of each stretch, and which of them are its own (the rest is context)."""
    if not _TELLING.search(text):
        return []
    near, last = [], -1
    for m in _TELLING.finditer(text):
        # A character range that holds REACH tokens each side, unless they are very long.
        a, b = max(0, m.start() - 12 * REACH), min(len(text), m.end() + 12 * REACH)
        if near and a <= last:
            near[-1][1] = b
        else:
            near.append([a, b])
        last = b
    found = []
    for a, b in near:
        # Never begin or end inside a token.
        while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
            a -= 1
        while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
            b += 1
        places = tokens_of(text, a, b)
        for at in range(0, len(places), LONGEST):
            before = max(0, at - REACH)
            part = places[before : at + LONGEST + REACH]
            found.append((part, at - before, min(at + LONGEST, len(places)) - before))
    return found


def plausible(kind: str, text: str) -> bool:
    digits = _DIGITS.sub("", text)
    if kind == "email":
        return len(text) < 320 and bool(_WRITTEN_OUT.fullmatch(text))
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


class _Taken:
    """The places that spans cover, as disjoint ranges in order."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted((a, b) for _, a, b in spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        last = bisect_left(self.starts, b) - 1
        return last < 0 or self.ends[last] <= a


def added_spans(texts: list[str], base: list[list[Span]], model: Crf) -> list[list[Span]]:
    """What the model finds beside the base spans of each text."""
    rows, of = [], []
    for i, text in enumerate(texts):
        for places, first, end in stretches(text):
            rows.append(_features(text, places))
            of.append((i, places, first, end))
    found: list[list[Span]] = [[] for _ in texts]
    taken = [_Taken(spans) for spans in base]
    for (i, places, first, end), labels in zip(of, model.decode(rows)):
        at = first
        while at < end:
            label = LABELS[labels[at]]
            at += 1
            if label[0] != "B":
                continue
            start, kind = at - 1, label[2:]
            while at < len(places) and LABELS[labels[at]] == f"I-{kind}":
                at += 1
            a, b = places[start][0], places[at - 1][1]
            # Stretches, and spans in them, come in order: only the last one added can reach this one.
            after_last = not found[i] or found[i][-1][2] <= a
            if after_last and taken[i].free(a, b) and plausible(kind, texts[i][a:b]):
                found[i].append((kind, a, b))
    return found


def all_spans(texts: list[str | None], model: Crf) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """Each text with its base and added spans."""
    texts = [text or "" for text in texts]
    base = [base_spans(text) for text in texts]
    return zip(texts, base, added_spans(texts, base, model))


SCHEMA = ", ".join(["doc_id long", *(f"n_{kind} long" for kind in KINDS), "base_sha256 string", "spans string"])


def find_personal_data(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """Counts and digest of the base spans, and all spans, per row of ``docs``."""
    model = model or train()
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [*[pa.int64()] * (1 + len(KINDS)), pa.string(), pa.string()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_batches(batches, BLOCK_BYTES):
            rows = []
            ids = batch.column("doc_id").to_pylist()
            for doc_id, (_, base, more) in zip(ids, all_spans(batch.column("text").to_pylist(), model)):
                counts = [sum(span[0] == kind for span in base) for kind in KINDS]
                digest = hashlib.sha256(spans_text(base).encode()).hexdigest()
                rows.append((doc_id, *counts, digest, spans_text(base + more)))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), types)), names)

    return docs.select("doc_id", "text").mapInArrow(find, SCHEMA)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of spans that overlap, by the first's."""
    parts, done = [], 0
    for kind, start, end in sorted(spans, key=lambda span: (span[1], -span[2])):
        if start >= done:
            parts += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def mask_personal_data(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """``docs`` with the spans of ``text`` masked and ``n_chars`` brought up to date."""
    model = model or train()

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_batches(batches, BLOCK_BYTES):
            old = batch.column("text").to_pylist()
            new = [
                text if was is not None else None
                for was, text in zip(old, (masked(t, base + more) for t, base, more in all_spans(old, model)))
            ]
            names = batch.schema.names
            batch = batch.set_column(names.index("text"), "text", pa.array(new, pa.string()))
            if "n_chars" in names:
                sizes = [None if t is None else len(t) for t in new]
                batch = batch.set_column(names.index("n_chars"), "n_chars", pa.array(sizes, pa.int64()))
            yield batch

    return docs.mapInArrow(mask, docs.schema)
