"""Hashes of words and word shingles, for a block of texts at once in numpy.

A word is a run that ``\\w+`` finds in the lower-case text. Texts of ASCII and
Latin-1 letters are split on their UTF-8 bytes without making a string per word:
a word's hash is the polynomial of its bytes, from differences of running sums.
Other texts are lower-cased and split by the pattern first, and hashed alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

WORDS = 5
# Bytes that are hashed together; a piece ends at a byte that is in no word.
PIECE = 1 << 20
_WORD = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15
_STEP = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64
)
_IN_WORD = np.zeros(256, bool)
for _c in range(256):
    _IN_WORD[_c] = _c >= 0x80 or chr(_c).isalnum() or _c == 0x5F
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


_UP = _powers(_BASE, PIECE)
_DOWN = _powers(pow(_BASE, -1, 1 << 64), PIECE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of 64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins (and the last ends)."""
    texts = texts.cast(pa.large_string())
    _, places, data = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


def _plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and places, texts of other letters replaced by their words."""
    data, places = _bytes_of(texts)
    high = data >= 0x80
    if high.any():
        lead = data == 0xC3
        after = np.zeros(len(data), bool)
        after[1:] = lead[:-1]
        odd = np.flatnonzero(high & ~lead & ~(after & (data != 0x97) & (data != 0xB7)))
        if len(odd):
            rows = np.unique(np.searchsorted(places, odd, side="right") - 1)
            listed = texts.to_pylist()
            for i in rows.tolist():
                listed[i] = " ".join(_WORD.findall(listed[i].lower()))
            data, places = _bytes_of(pa.array(listed, pa.large_string()))
    return data, places


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's begin (and end)."""
    data, places = _plain(texts.fill_null(""))
    inside = _IN_WORD[data]
    # A text's first byte begins a word even where the text before ends in one.
    first = np.zeros(len(data) + 1, bool)
    first[places] = True
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    lower = _LOWER[data]
    if (data >= 0x80).any():
        lead = np.zeros(len(data), bool)
        lead[1:] = data[:-1] == 0xC3
        lower[lead & (data >= 0x80) & (data <= 0x9E)] += 0x20
    codes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        # Words that begin and end within a piece; one that is longer is a piece of its own.
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        n = int(ends[to - 1] - base)
        up, down = (_UP, _DOWN) if n <= PIECE else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((lower[base : base + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        a, b = starts[at:to] - base, ends[at:to] - base
        codes[at:to] = mix((sums[b] - sums[a]) * down[a])
        at = to
    return codes, np.searchsorted(starts, places)


def shingle_codes(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in order, and where each text's begin.

    A text of fewer words than a shingle has is one shingle, one without words none.
    """
    codes, places = word_codes(texts)
    sizes = np.diff(places)
    counts = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    out = np.concatenate([[0], np.cumsum(counts)])
    # The word at which each shingle begins, and how many words it has.
    begin = np.arange(out[-1]) + np.repeat(places[:-1] - out[:-1], counts)
    width = np.repeat(np.minimum(sizes, words), counts)
    found = width.astype(np.uint64)
    for i in range(words):
        own = codes[np.minimum(begin + i, max(len(codes) - 1, 0))] if len(codes) else codes
        found = np.where(i < width, (found + own) * _STEP[i % len(_STEP)], found)
        found ^= found >> np.uint64(31)
    return mix(found), out


def split(found: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    return [found[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
