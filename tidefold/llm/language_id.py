"""Language ID by unigrams over word pieces, summed over all segmentations.

Each language has a probability for each piece of a fixed public vocabulary. The
probability of a word is the sum over every way to cut it into pieces, by a
forward pass from left to right; that of a text is the product over its words.
Pieces never cross words, so a word's score is computed once per block and
looked up by frequency. Blocks of distinct words of one length go through numpy
together, and what a worker knows is kept up to ``KNOWN_WORDS``.

Learning is expectation-maximisation with the backward pass, from the words of
at most about ``SAMPLE_DOCS`` labelled documents of each language, chosen by the
hash of their id and counted in Spark; only these word counts reach the driver.

Words are runs of letters in lower case; runs over ``LONGEST`` letters are cut
into pieces of that length. A letter that no piece covers has probability
``UNKNOWN``.

Defined results: a null text, or one without a letter, is ``und`` with score 0,
and so is every text where there is no labelled row; ties go to the language that
sorts first; repeated rows, null ids and null labels are allowed (rows with
either null are not learned from); an empty table gives no rows; other columns are kept.
Very long texts are scored whole. The score is the posterior among the learned languages:
of a long text it is near 1 whatever its language.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.llm.common import whole_batches

VOCABULARY = "piece_bpe_32k.model"
UNDETERMINED = "und"
SAMPLE_DOCS = 300
ROUNDS = 3
UNKNOWN = 1e-7
LONGEST = 32
START = "▁"
KNOWN_WORDS = 300_000
BLOCK_BYTES = 8 << 20
# Words that go through the forward pass together.
TOGETHER = 8_192
_WORD = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> Counter:
    """Frequencies of the words of a text, long ones cut."""
    found = Counter(_WORD.findall(text.lower() if text else ""))
    odd = [w for w in found if len(w) > LONGEST or not w.isalpha()]
    for word in odd:
        n = found.pop(word)
        letters = "".join(filter(str.isalpha, word))
        for at in range(0, len(letters), LONGEST):
            found[letters[at : at + LONGEST]] += n
    return found


def public_pieces(file: str) -> list[str]:
    """Pieces that can stand in a lower-case word: letters, with or without the word start."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(file))
    every = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    bare = lambda piece: piece.removeprefix(START)
    return [p for p in every if p == START or (bare(p).isalpha() and bare(p) == bare(p).lower())]


def _hashes(chars: np.ndarray, most: int) -> list[np.ndarray]:
    """For each length from 1, the hash of every substring: (words, starts)."""
    found, rolling = [], None
    width = chars.shape[1]
    codes = chars.astype(np.uint64) + np.uint64(1)
    for length in range(1, min(most, width) + 1):
        tail = codes[:, length - 1 :]
        rolling = tail if rolling is None else rolling[:, : tail.shape[1]] * _BASE + tail
        found.append(rolling ^ (rolling >> np.uint64(29)))
    return found


def _chars(words: list[str]) -> np.ndarray:
    """Code points of words of one length: (words, length)."""
    width = len(words[0])
    return np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)


class PieceModel:
    """Piece probabilities of each language, and word scores by the forward pass."""

    def __init__(self, pieces: list[str], langs: list[str], probs: np.ndarray):
        self.langs = langs
        by_hash: dict[int, int] = {}
        lengths = defaultdict(list)
        for i, piece in enumerate(pieces):
            lengths[len(piece)].append(i)
        for own in lengths.values():
            for i, h in zip(own, _hashes(_chars([pieces[i] for i in own]), 99)[-1][:, 0].tolist()):
                by_hash.setdefault(h, i)
        order = sorted(by_hash)
        self.keys = np.array(order, np.uint64)
        self.places = np.array([by_hash[h] for h in order], np.int32)
        self.pieces, self.most = pieces, max(lengths)
        # The last row stands for substrings that are no piece.
        self.probs = np.vstack([probs, np.zeros((1, probs.shape[1]))])

    def ids(self, chars: np.ndarray) -> list[np.ndarray]:
        """For each length from 1, the piece of every substring or the last row."""
        none, found = len(self.pieces), []
        for h in _hashes(chars, self.most):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            found.append(np.where(self.keys[at] == h, self.places[at], none))
        return found

    def forward(self, ids: list[np.ndarray]) -> np.ndarray:
        """(position, words, languages): probability of the first letters."""
        n, width = ids[0].shape
        sums = np.zeros((width + 1, n, len(self.langs)))
        sums[0] = 1
        for end in range(1, width + 1):
            for length in range(1, min(end, len(ids)) + 1):
                own = ids[length - 1][:, end - length]
                step = self.probs[own]
                if length == 1:
                    step = np.maximum(step, UNKNOWN)
                sums[end] += sums[end - length] * step
        return sums

    def backward(self, ids: list[np.ndarray]) -> np.ndarray:
        n, width = ids[0].shape
        sums = np.zeros((width + 1, n, len(self.langs)))
        sums[width] = 1
        for start in range(width - 1, -1, -1):
            for length in range(1, min(width - start, len(ids)) + 1):
                step = self.probs[ids[length - 1][:, start]]
                if length == 1:
                    step = np.maximum(step, UNKNOWN)
                sums[start] += sums[start + length] * step
        return sums

    def grouped(self, words) -> Iterator[list[str]]:
        by_length = defaultdict(list)
        for word in words:
            by_length[len(word)].append(word)
        for own in by_length.values():
            for at in range(0, len(own), TOGETHER):
                yield own[at : at + TOGETHER]

    def scores(self, words) -> tuple[list[str], np.ndarray]:
        """Words, in an order of its own, and their log probabilities per language."""
        names, rows = [], [np.zeros((0, len(self.langs)))]
        for own in self.grouped(words):
            names += own
            ids = self.ids(_chars([START + word for word in own]))
            rows.append(np.log(np.maximum(self.forward(ids)[-1], 1e-300)))
        return names, np.concatenate(rows)

    def expected(self, counts: dict[str, np.ndarray]) -> np.ndarray:
        """Expected uses of each piece, from counts of words per language."""
        uses = np.zeros_like(self.probs)
        for own in self.grouped(counts):
            ids = self.ids(_chars([START + word for word in own]))
            ahead, behind = self.forward(ids), self.backward(ids)
            weight = np.array([counts[word] for word in own]) / np.maximum(ahead[-1], 1e-300)
            for length, own_ids in enumerate(ids, 1):
                for start in range(own_ids.shape[1]):
                    at = own_ids[:, start]
                    hit = at < len(self.pieces)
                    if hit.any():
                        part = ahead[start] * self.probs[at] * behind[start + length] * weight
                        np.add.at(uses, at[hit], part[hit])
        return uses[:-1]


def fit(counts: dict[str, dict[str, int]], pieces: list[str], rounds: int = ROUNDS) -> PieceModel | None:
    """A model from ``{language: {word: count}}``; None without any."""
    langs = sorted(lang for lang, own in counts.items() if own)
    if not langs:
        return None
    words: dict[str, np.ndarray] = {}
    for i, lang in enumerate(langs):
        for word, n in counts[lang].items():
            words.setdefault(word, np.zeros(len(langs)))[i] = n
    model = PieceModel(pieces, langs, np.full((len(pieces), len(langs)), 1 / len(pieces)))
    for _ in range(rounds):
        uses = model.expected(words)
        # Pieces that no language uses are alike for all of them; the letters cover them.
        used = uses.max(axis=1) > 0.5
        pieces = [p for p, keep in zip(model.pieces, used) if keep] or pieces[:1]
        uses = uses[used] if used.any() else uses[:1]
        model = PieceModel(pieces, langs, (uses + 0.1) / (uses + 0.1).sum(axis=0))
    return model


def held_out() -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in whole_batches(batches, BLOCK_BYTES):
        sums = defaultdict(Counter)
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            sums[lang].update(words_of(text))
        rows = [(lang, word, n) for lang, own in sums.items() for word, n in own.items()]
        if rows:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows))), ["lang", "word", "n"])


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, vocabulary: str = VOCABULARY) -> PieceModel | None:
    """A model from labelled rows that are not held out."""
    known = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    sizes = {row["lang"]: row["n"] for row in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    parts = 1 << 30
    place = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    chosen = F.lit(False)
    for lang, n in sorted(sizes.items()):
        chosen = chosen | ((F.col("lang") == lang) & (place < F.lit(max(1, min(parts, sample_docs * parts // n)))))
    counted = (
        known.where(chosen)
        .select("lang", "text")
        .mapInArrow(_word_counts, "lang string, word string, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    counts = defaultdict(dict)
    for lang, word, n in zip(*(counted.column(name).to_pylist() for name in ("lang", "word", "n"))):
        counts[lang][word] = n
    return fit(counts, public_pieces(vocabulary))


class Judge:
    """Languages of texts, keeping what it knows of words between blocks."""

    def __init__(self, model: PieceModel | None, most: int = KNOWN_WORDS):
        self.model, self.most = model, most
        self._forget()

    def _forget(self):
        self.places: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.model.langs) if self.model else 0))

    def judge(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        tables = [words_of(text) for text in texts]
        if self.model is None:
            return [UNDETERMINED] * len(tables), [0.0] * len(tables)
        names, logs = self.model.scores({w for own in tables for w in own if w not in self.places})
        self.places.update(zip(names, range(len(self.logs), len(self.logs) + len(names))))
        self.logs = np.concatenate([self.logs, logs])
        langs, scores = [], []
        for own in tables:
            if not own:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            at = np.fromiter(map(self.places.__getitem__, own), np.int64, len(own))
            total = np.fromiter(own.values(), np.float64, len(own)) @ self.logs[at]
            share = np.exp(total - total.max())
            best = int(share.argmax())
            langs.append(self.model.langs[best])
            scores.append(float(share[best] / share.sum()))
        if len(self.places) > self.most:
            self._forget()
        return langs, scores


def identify(
    docs: DataFrame, model: PieceModel | None, columns: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with a language and a score, from ``text`` alone, in two new columns.

    A column of ``docs`` that has one of the new names gives way to it.
    """
    kept = docs.drop(*columns)
    fields = [pa.field(columns[0], pa.string()), pa.field(columns[1], pa.float64())]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge_of = Judge(model)
        for batch in whole_batches(batches, BLOCK_BYTES):
            langs, scores = judge_of.judge(batch.column("text").to_pylist())
            for field, values in zip(fields, (langs, scores)):
                batch = batch.append_column(field, pa.array(values, field.type))
            yield batch

    added = [T.StructField(columns[0], T.StringType()), T.StructField(columns[1], T.DoubleType())]
    return kept.mapInArrow(judge, T.StructType(kept.schema.fields + added))
