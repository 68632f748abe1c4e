"""A run-length grammar of an integer sequence by recompression, and its LCE queries.

Each round replaces maximal blocks of one symbol, then pairs of neighbours: symbols
are divided in two classes by a hash, and every left one followed by a right one
becomes one new symbol. What merges depends on the two symbols alone, so equal
stretches are parsed alike but for their ends, and two symbols of one level are the
same exactly if they stand for the same text. A sequence shrinks by a quarter or so
a round, so all levels together are about four times its length.

The longest common extension of two places walks these levels: equal symbols are
stepped over, whole blocks at once; where both places begin a symbol of the next
level the walk goes up, where symbols differ it goes down, until the lowest level
differs. Many queries walk together in numpy.

The sequence must begin and end with a value that occurs nowhere else; values like
that between its parts (documents) keep every extension inside its part.
"""

from __future__ import annotations

import numpy as np

# Odd multipliers of the hashes that divide symbols; each round tries a few.
_HASHES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
MOST_ROUNDS = 200


def _names(keys: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """Fresh symbols for equal keys, and the next fresh one."""
    found, at = np.unique(keys, return_inverse=True)
    return first + at, first + len(found)


def _pairs(symbols: np.ndarray, turn: int) -> np.ndarray:
    """Places of the left halves of the pairs to merge, of the best of a few divisions."""
    best = np.zeros(0, np.int64)
    for hash_ in _HASHES:
        side = (symbols.astype(np.uint64) + np.uint64(turn)) * hash_ >> np.uint64(61) & np.uint64(1) == 1
        for left, right in ((side[:-1], ~side[1:]), (~side[:-1], side[1:])):
            places = np.flatnonzero(left & right)
            if len(places) > len(best):
                best = places
        if len(best) * 4 > len(symbols):
            break
    return best


class Grammar:
    """Levels of the grammar of ``text`` as flat arrays of nodes; node i < n is place i."""

    def __init__(self, text: np.ndarray, roots: int = 64):
        symbols = np.asarray(text, np.int64)
        fresh = int(symbols.max(initial=0)) + 1
        parts: dict[str, list[np.ndarray]] = {k: [] for k in ("symbol", "ahead", "behind", "up", "down", "begins")}
        self.size = len(symbols)
        base, below = 0, np.zeros(len(symbols), np.int64)
        for turn in range(MOST_ROUNDS):
            starts = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
            lengths = np.diff(starts, append=len(symbols))
            place = np.arange(len(symbols)) - np.repeat(starts, lengths)
            blocks, many = symbols[starts], lengths > 1
            if many.any():
                span = int(lengths.max()) + 1
                blocks[many], fresh = _names(blocks[many] * span + lengths[many], fresh)
            left = _pairs(blocks, turn)
            keep = np.ones(len(blocks), bool)
            keep[left + 1] = False
            if len(left):
                blocks[left], fresh = _names(blocks[left] * fresh + blocks[left + 1], fresh)
            parent = np.cumsum(keep) - 1
            done = len(symbols) <= roots or turn == MOST_ROUNDS - 1
            above = base + len(symbols)
            begins = np.zeros(len(symbols), bool)
            if not done:
                begins[starts[keep]] = True
            parts["symbol"].append(symbols)
            parts["ahead"].append(np.repeat(lengths, lengths) - place)
            parts["behind"].append(place + 1)
            parts["up"].append(above + np.repeat(parent, lengths))
            parts["down"].append(below)
            parts["begins"].append(begins)
            if done:
                break
            below = base + starts[keep]
            symbols, base = blocks[keep], above
        small = np.int32 if base < 1 << 30 else np.int64
        for name, arrays in parts.items():
            whole = np.concatenate(arrays)
            setattr(self, name, whole if name in ("begins", "symbol") else whole.astype(small))

    def common_ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of what begins at ``x`` and at ``y`` (other places)."""
        return self._walk(x, y, 0)

    def common_behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of what ends before ``x`` and before ``y``."""
        return self._walk(x, y, 1)

    def _walk(self, x: np.ndarray, y: np.ndarray, back: int) -> np.ndarray:
        reach, sign = (self.behind, -1) if back else (self.ahead, 1)
        out = np.zeros(len(x), np.int64)
        query, i, j = np.arange(len(x)), np.array(x, np.int64), np.array(y, np.int64)
        while len(query):
            at, other = i - back, j - back
            same = self.symbol[at] == self.symbol[other]
            step = np.minimum(reach[at], reach[other])
            step[~same] = 0
            i, j = i + sign * step, j + sign * step
            ended = ~same & (i < self.size)
            out[query[ended]] = np.abs(i[ended] - np.asarray(x)[query[ended]])
            rise = same & self.begins[i] & self.begins[j]
            i, j = np.where(rise, self.up[i], np.where(same, i, self.down[i])), np.where(
                rise, self.up[j], np.where(same, j, self.down[j])
            )
            query, i, j = query[~ended], i[~ended], j[~ended]
        return out
