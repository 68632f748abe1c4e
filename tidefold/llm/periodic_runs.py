"""Periodic runs of words: stretches that repeat a period, found exactly.

A run of period q and at least ``times`` periods covers ``times`` neighbouring points
of the grid 0, q, 2q, ..., which then hold the same word. ``word_runs`` looks at these
points for every q (n + n/2 + n/3 + ... of them), and asks the grammar of the words
(``grammar``) how far the words q apart agree ahead of and behind each point that is
left: the exact ends of the run. A stretch found for several q has the smallest as its
period. Points inside a run already known whose period divides q are left out, as they
can only give that run again.

Documents are taken in blocks of ``BLOCK_WORDS`` words; nothing is shuffled, and a lost
executor costs its own tasks. Memory follows the block, or a single longer text, at
about 200 bytes a word; candidates are settled ``MOST_POINTS`` at a time.

Defined results: a null or empty text, or one of white space alone, has no words and no
runs and collapses to the empty text; repeated rows and null ids come out each; an empty
table gives no rows; other columns are not looked at. Very long texts are taken whole.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidefold.llm.common import whole_batches
from tidefold.llm.grammar import Grammar

LEAST_WORDS = 6
TIMES = 4
BLOCK_WORDS = 400_000
BLOCK_BYTES = 4 << 20
MOST_POINTS = 1 << 18

RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class _Known:
    """Runs found so far, with the period of a run that covers each place."""

    def __init__(self, size: int):
        self.runs: dict[tuple[int, int], int] = {}
        self.period = np.ones(size, np.int64)
        self.end = np.zeros(size, np.int64)

    def news(self, points: np.ndarray, period: np.ndarray, times: int) -> np.ndarray:
        """Which points do not lie, for ``times`` periods, inside a run that they would only repeat."""
        inside = (self.end[points] > points + (times - 1) * period) & (period % self.period[points] == 0)
        return ~inside

    def add(self, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        order = np.lexsort((period, end, start))
        start, end, period = start[order], end[order], period[order]
        first = np.ones(len(start), bool)
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        for s, e, q in zip(start[first].tolist(), end[first].tolist(), period[first].tolist()):
            if self.runs.setdefault((s, e), q) == q:
                self.period[s:e] = q
                self.end[s:e] = e


def word_runs(text: np.ndarray, longest: int, least: int = LEAST_WORDS, times: int = TIMES) -> np.ndarray:
    """``(start, length, period)`` of every run, by start, then period.

    ``text`` holds word numbers; its parts, of ``longest`` words at most, stand between
    values that occur once.
    """
    grammar, known = Grammar(text), _Known(len(text))
    waiting: list[tuple[np.ndarray, int]] = []
    points = 0

    def settle() -> None:
        place = np.concatenate([at for at, _ in waiting])
        period = np.repeat([q for _, q in waiting], [len(at) for at, _ in waiting])
        new = known.news(place, period, times)
        for cut in range(0, new.sum(), MOST_POINTS):
            x, q = place[new][cut : cut + MOST_POINTS], period[new][cut : cut + MOST_POINTS]
            start = x - grammar.common_behind(x, x + q)
            end = x + q + grammar.common_ahead(x, x + q)
            run = end - start >= np.maximum(least, times * q)
            known.add(start[run], end[run], q[run])
        waiting.clear()

    for q in range(1, longest // times + 1):
        grid = text[::q]
        agree = grid[1:] == grid[:-1]
        hit = agree[: len(agree) - times + 2]
        for k in range(1, times - 1):
            hit = hit & agree[k : len(agree) - times + 2 + k]
        at = np.flatnonzero(hit) * q
        if len(at):
            waiting.append((at, q))
            points += len(at)
        # Small periods first, so that their runs answer for their multiples.
        if waiting and (q & (q - 1) == 0 or points >= MOST_POINTS):
            settle()
            points = 0
    if waiting:
        settle()
    found = np.array([(s, e - s, q) for (s, e), q in known.runs.items()], np.int64).reshape(-1, 3)
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def text_runs(texts: list[bytes | None], least: int = LEAST_WORDS, times: int = TIMES) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Words, runs and the text without what repeats, per text."""
    number = defaultdict(count().__next__)
    words = [text.split() if text else [] for text in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    # A place that holds a value of its own before each text, and one behind the last.
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))
    numbers = np.empty(begin[-1] + 1, np.int64)
    for w, at in zip(words, begin):
        numbers[at + 1 : at + 1 + len(w)] = list(map(number.__getitem__, w))
    numbers[begin] = len(number) + np.arange(len(begin))
    runs = word_runs(numbers, int(sizes.max(initial=0)), least, times)
    dropped = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(dropped) == 0
    cuts = np.searchsorted(runs[:, 0], begin)
    for k, w in enumerate(words):
        own = runs[cuts[k] : cuts[k + 1]] - (begin[k] + 1, 0, 0)
        left = compress(w, kept[begin[k] + 1 : begin[k + 1]].tolist()) if len(own) else w
        yield len(w), own, b" ".join(left)


def _blocks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Bounds of blocks of about ``BLOCK_WORDS`` words, by a fast upper bound of their number."""
    begin, words = 0, 0
    for k, text in enumerate(texts):
        size = (len(text or b"") + 1) // 2
        if words and words + size > 4 * BLOCK_WORDS:
            yield begin, k
            begin, words = k, 0
        words += size
    if begin < len(texts):
        yield begin, len(texts)


def periodic_runs(docs: DataFrame, least: int = LEAST_WORDS, times: int = TIMES) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` per row of ``docs``.

    ``collapsed`` joins by one space the words that no run contains after its first period.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_batches(batches, BLOCK_BYTES):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids = batch.column("doc_id").cast(pa.int64())
            for begin, end in _blocks(texts):
                sizes, runs, collapsed = zip(*text_runs(texts[begin:end], least, times))
                rows = [[dict(zip(("start", "length", "period"), run)) for run in own.tolist()] for own in runs]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(begin, end - begin),
                        pa.array(sizes, pa.int64()),
                        pa.array(rows, RUN),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(find, SCHEMA)
