"""Packing of lengths by patterns: a plan made from a histogram alone.

Patterns of up to three lengths that fill a sequence (or come as near as the lengths
at hand allow) are enumerated; non-negative least squares fits how often each is used
to the histogram; the counts are rounded and cut to what is there. What is left is
packed by best fit in falling length, into the room that patterns leave first, whole
counts of equal lengths and equal sequences at a time. The work and the plan depend on
the number of distinct lengths, at most the capacity, not on how many documents have
them.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np

# Patterns tried per longest length, and steps of the fit.
PER_LENGTH = 24
FIT_STEPS = 200
# A pattern may leave this part of a sequence; short documents fill it, or go by best fit.
CLOSE = 512
# Shares of the fitted repeats that are tried.
SHARES = (1.0, 0.7, 0.4)


def enumerate_patterns(lengths: np.ndarray, capacity: int, per_length: int = PER_LENGTH) -> np.ndarray:
    """Places in ascending ``lengths`` of up to three documents, falling; -1 for none.

    Only patterns that leave ``capacity // CLOSE`` at most; of a longest length those that
    leave the least, evenly chosen where there are more than ``per_length``.
    """
    patterns = []
    for a, longest in enumerate(lengths):
        room = capacity - longest
        b = np.arange(min(a + 1, np.searchsorted(lengths, room, side="right")))
        if not len(b):
            if room <= capacity // CLOSE:
                patterns.append(np.array([[a, -1, -1]]))
            continue
        rest = room - lengths[b]
        c = np.minimum(np.searchsorted(lengths, rest, side="right") - 1, b)
        waste = rest - np.where(c >= 0, lengths[c], 0)
        order = np.lexsort((b, waste))
        tied = max(per_length, np.searchsorted(waste[order], waste[order[0]], side="right"))
        chosen = order[:tied][np.unique(np.linspace(0, min(tied, len(order)) - 1, per_length).astype(int))]
        chosen = chosen[waste[chosen] <= capacity // CLOSE]
        patterns.append(np.column_stack((np.full(len(chosen), a), b[chosen], c[chosen])))
    return np.concatenate(patterns) if patterns else np.zeros((0, 3), np.int64)


def fit(patterns: np.ndarray, counts: np.ndarray, weights: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Repeats x >= 0 with least weighted squares of (documents used - ``counts``), by accelerated projected gradient."""
    places = np.where(patterns < 0, len(counts), patterns)
    weights = np.append(weights, 0.0)
    goal = np.append(counts, 0).astype(float)

    def used(x):
        return np.bincount(places.ravel(), np.repeat(x, places.shape[1]), len(goal))

    # A bound of the largest eigenvalue, by the row sums of the (non-negative) normal matrix.
    steepest = (weights[places] * used(np.ones(len(places)))[places]).sum(1).max(initial=1.0)
    x = y = np.zeros(len(places))
    turn = 1.0
    for _ in range(steps):
        slope = (weights * (used(y) - goal))[places].sum(1)
        after = np.maximum(0.0, y - slope / steepest)
        following = (1 + np.sqrt(1 + 4 * turn * turn)) / 2
        y = after + (turn - 1) / following * (after - x)
        x, turn = after, following
    return x


@dataclass
class Plan:
    """Where the documents of each length go, by their rank among those of that length.

    A row of ``slots`` (length, first rank, first sequence, offset, per sequence) covers
    ranks from its first on, to the next row of its length; ``per sequence`` of them lie
    one behind the other in each sequence.
    """

    capacity: int
    sequences: int = 0
    slots: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    ranks: dict[int, int] = field(default_factory=dict)
    # Sequences of equal room: (first, how many), by that room.
    open: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def add(self, length: int, first: int, sequences: int, room: int, each: int, documents: int) -> None:
        """``documents`` of one length into ``sequences`` of equal room, ``each`` per sequence."""
        rank = self.ranks.get(length, 0)
        self.slots.append((length, rank, first, self.capacity - room, each))
        self.ranks[length] = rank + documents
        left = room - each * length
        if left:
            self.open.setdefault(left, []).append((first, sequences))

    def repeat(self, lengths: list[int], times: int) -> None:
        """A pattern, ``times`` over, in new sequences."""
        room = self.capacity
        for k, length in enumerate(lengths):
            rank = self.ranks.get(length, 0)
            self.slots.append((length, rank, self.sequences, self.capacity - room, 1))
            self.ranks[length] = rank + times
            room -= length
        if room:
            self.open.setdefault(room, []).append((self.sequences, times))
        self.sequences += times

    def _take(self, length: int, documents: int, first: int, sequences: int, room: int) -> int:
        """Put what fits into sequences of equal room; how many documents that is."""
        each = room // length
        full = min(sequences, documents // each)
        if full:
            self.add(length, first, full, room, each, full * each)
        taken = full * each
        if full < sequences and documents > taken:
            self.add(length, first + full, 1, room, documents - taken, documents - taken)
            full, taken = full + 1, documents
        if full < sequences:
            self.open.setdefault(room, []).append((first + full, sequences - full))
        return taken

    def best_fit(self, length: int, documents: int) -> None:
        """Place documents of one length where they leave the least room."""
        while documents:
            fitting = [room for room in self.open if room >= length]
            if not fitting:
                sequences = -(-documents // (self.capacity // length))
                self._take(length, documents, self.sequences, sequences, self.capacity)
                self.sequences += sequences
                return
            room = min(fitting)
            groups = self.open[room]
            first, sequences = groups.pop()
            if not groups:
                del self.open[room]
            documents -= self._take(length, documents, first, sequences, room)


def plan_packing(histogram: Mapping[int, int], capacity: int) -> Plan:
    """A plan for ``histogram`` (length 1 to ``capacity`` to documents).

    Where long documents abound, patterns can use up the short ones that best fit would
    put beside them; so a few shares of the fitted repeats are tried, and the plan of the
    fewest sequences is kept.
    """
    lengths = np.array(sorted(histogram), np.int64)
    counts = np.array([histogram[length] for length in lengths.tolist()], np.int64)
    patterns = enumerate_patterns(lengths, capacity)
    # Long documents are harder to place later, so their misfit weighs more.
    repeats = fit(patterns, counts, lengths / capacity)
    plans = (_rounded(capacity, lengths, counts, patterns, repeats * share) for share in SHARES)
    return min(plans, key=lambda plan: plan.sequences)


def _rounded(capacity: int, lengths: np.ndarray, counts: np.ndarray, patterns: np.ndarray, repeats: np.ndarray) -> Plan:
    """Patterns as often as ``repeats`` says, rounded down, while there are documents; best fit for the rest."""
    plan, left = Plan(capacity), counts.copy()
    for at in np.argsort(-repeats, kind="stable"):
        if repeats[at] < 1:
            break
        own = patterns[at][patterns[at] >= 0]
        places, each = np.unique(own, return_counts=True)
        times = min(int(repeats[at]), int((left[places] // each).min()))
        if times:
            left[places] -= each * times
            plan.repeat(lengths[own].tolist(), times)
    for length, documents in zip(lengths[::-1].tolist(), left[::-1].tolist()):
        plan.best_fit(length, documents)
    return plan
