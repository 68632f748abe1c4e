"""Removal of repeated strings by difference-cover suffix sorting.

Every byte goes that a string of ``LENGTH`` bytes covers which also starts
earlier (smaller doc_id, or before it in the same document).

Suffixes that cannot match are set aside first, exactly. A rolling hash names
each run of ``GRAM`` bytes; the least name in a window of ``LENGTH`` bytes is its
anchor, and windows that are equal have the same anchor at the same place. So
only windows whose anchor occurs twice can repeat, and only with windows of the
same anchor. Anchors are counted (combined before the shuffle), and bitmaps of
fixed size tell the second pass which occur again; a bit that is set by chance
costs work and changes nothing. The contexts of such anchors, the bytes of all
windows that they name, are dealt out by anchor.

Each task then orders the suffixes of its contexts by the difference-cover
algorithm: sample the places that are 1 or 2 modulo 3, sort their triples, recurse
on the triples' names until names span ``LENGTH`` bytes, order the remaining
suffixes by first byte and the rank behind it, merge, and compare neighbours'
first ``LENGTH`` bytes. The first of equal ones stays.

Equal contexts are reduced to the earliest within a block of documents before
they are shuffled, so a passage that a third of all documents hold arrives as
one row per block. Anchors that occur more than ``HOT`` times are dealt in bands
of ``BAND`` offsets each, keyed by the bytes that all windows of a band share, so
their contexts spread. Texts are shuffled once, to meet what goes from them.

Defined results: null texts are empty; texts under ``LENGTH`` bytes lose nothing;
rows without an id come last; of rows of one id, the one whose text hashes lower
comes first, and rows that repeat id and text lose all of it but once; an empty
table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import HashFilter, scratch_of, whole_batches
from tidefold.llm.shingles import _DOWN, _UP, PIECE, _bytes_of, mix

LENGTH = 100
GRAM = 32
REACH = LENGTH - GRAM + 1
BITS = 1 << 27
HOT = 20_000
BAND = 8
BLOCK_BYTES = 4 << 20
# Bytes of contexts that are ordered together, and of a text that are hashed together.
SORT_BYTES = 1 << 20
STRIDE = 1 << 19
LAST_ID = (1 << 63) - 1
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- suffix order -----------------------------------------------------------


def suffix_order(codes: np.ndarray, span: int) -> np.ndarray:
    """Places in an order of their suffixes that is right for ``span`` symbols.

    Codes are at least 1; places behind the end count as 0.
    """
    n = len(codes)
    if span <= 1:
        return np.argsort(codes, kind="stable")
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: tuple(codes[i:])), np.int64)
    padded = np.concatenate([codes, np.zeros(3, np.int64)])
    # With n of remainder 1, a place behind the end closes the first half of the names.
    sample = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    names, distinct = _names(padded[sample], padded[sample + 1], padded[sample + 2])
    if distinct < len(sample) and span > 3:
        # A name spans three symbols; one more lets halves end within a name.
        order = suffix_order(names + 1, -(-span // 3) + 1)
        rank = np.empty(len(sample), np.int64)
        rank[order] = np.arange(1, len(sample) + 1)
    else:
        rank, order = names + 1, np.argsort(names, kind="stable")
    ranks = np.zeros(n + 3, np.int64)
    ranks[sample] = rank
    top = np.int64(len(sample) + 2)
    rest = np.arange(0, n, 3)
    key = padded[rest] * top + ranks[rest + 1]
    rest = rest[np.argsort(key, kind="stable")]
    ordered = sample[order]
    ordered = ordered[ordered < n]
    ones, twos = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    ahead = np.searchsorted(padded[ones] * top + ranks[ones + 1], padded[rest] * top + ranks[rest + 1])
    # Two symbols and a rank: the symbols' pair is named first.
    pair, _ = _names(
        np.concatenate([padded[twos], padded[rest]]), np.concatenate([padded[twos + 1], padded[rest + 1]])
    )
    behind = np.searchsorted(pair[: len(twos)] * top + ranks[twos + 2], pair[len(twos) :] * top + ranks[rest + 2])
    # Suffixes that agree for the whole span may stand in any order; counts must not fall.
    at = np.arange(len(rest)) + np.maximum.accumulate(ahead) + np.maximum.accumulate(behind)
    merged = np.full(n, -1, np.int64)
    merged[at] = rest
    merged[merged < 0] = ordered
    return merged


def _names(*columns: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks of rows of small numbers, and how many differ."""
    bits = max(1, int(max(c.max(initial=0) for c in columns)).bit_length())
    if bits * len(columns) <= 63:
        packed = columns[0]
        for column in columns[1:]:
            packed = (packed << bits) | column
        order = np.argsort(packed, kind="stable")
        changed = packed[order][1:] != packed[order][:-1]
    else:
        order = np.lexsort(columns[::-1])
        changed = np.zeros(max(len(order) - 1, 0), bool)
        for column in columns:
            changed |= column[order][1:] != column[order][:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(changed)])[: len(order)]
    return names, int(changed.sum()) + 1


def equal_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows in the joined texts, in suffix order, and whether each
    equals the one before it."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    ends = np.repeat(np.cumsum(sizes), sizes)
    order = suffix_order(data.astype(np.int64) + 1, LENGTH)
    order = order[order + LENGTH <= ends[order]]
    same = np.zeros(len(order), bool)
    window = np.arange(LENGTH)
    for at in range(1, len(order), 8192):
        part = order[at - 1 : at + 8192]
        rows = data[part[:, None] + window]
        same[at : at + 8192] = (rows[1:] == rows[:-1]).all(axis=1)
    return order, same


# --- anchors ----------------------------------------------------------------


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each run of ``width`` values."""
    done = 1
    while 2 * done <= width:
        values = pick(values[: len(values) - done], values[done:])
        done *= 2
    rest = width - done
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one piece: names of grams, least names of windows, anchor places, running sums."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[: len(data)], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(data) - GRAM + 1])
    least = _slide(grams, REACH, np.minimum)
    edge = np.zeros(REACH - 1, np.uint64)
    most = _slide(np.concatenate([edge, least, edge]), REACH, np.maximum)
    return grams, least, np.flatnonzero(most == grams), sums


def _pieces(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """A text in pieces that share all but one start of a window with none."""
    for at in range(0, max(len(data) - LENGTH + 1, 0), STRIDE):
        yield at, data[at : at + STRIDE + LENGTH - 1]


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in whole_batches(batches, BLOCK_BYTES):
        data, places = _bytes_of(batch.column("text"))
        found = []
        for a, b in zip(places[:-1].tolist(), places[1:].tolist()):
            for _, piece in _pieces(data[a:b]):
                grams, _, at, _ = _anchors(piece)
                found.append(grams[at])
        if found:
            names, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(counts)], ["anchor", "n"])


CONTEXTS = "group long, id long, digest long, low int, high int, context binary"
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_NAMES = [part.split()[0] for part in CONTEXTS.split(", ")]


def _contexts(twice: HashFilter, hot: HashFilter):
    """The contexts of anchors that occur again, equal ones of a block only once.

    ``low`` and ``high`` are the first and last start of the windows; a row without
    a context has an earlier equal one already.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(REACH)
        for batch in whole_batches(batches, BLOCK_BYTES):
            data, places = _bytes_of(batch.column("text"))
            ids, digests = batch.column("id").to_pylist(), batch.column("digest").to_pylist()
            docs = sorted(range(len(ids)), key=lambda i: (ids[i], digests[i]))
            seen: dict[tuple[int, int, int], tuple[int, int, int]] = {}
            out: list[tuple] = []
            for i in docs:
                own = data[places[i] : places[i + 1]]
                for base, piece in _pieces(own):
                    grams, least, at, sums = _anchors(piece)
                    at = at[twice(grams[at])]
                    if not len(at):
                        continue
                    names = grams[at]
                    # The windows of an anchor: those that hold it and have no lesser name.
                    starts = at[:, None] - steps[::-1]
                    fits = (starts >= 0) & (starts < len(least))
                    fits &= least[np.clip(starts, 0, len(least) - 1)] == names[:, None]
                    some = fits.any(axis=1)
                    low = starts[np.arange(len(at)), fits.argmax(axis=1)][some]
                    high = starts[np.arange(len(at)), REACH - 1 - fits[:, ::-1].argmax(axis=1)][some]
                    at, names, groups = at[some], names[some], names[some]
                    burning = hot(names)
                    if burning.any():
                        low, high, at, names, groups = _bands(low, high, at, names, burning, sums)
                    ends = high + LENGTH
                    hashes = mix((sums[ends] - sums[low]) * _DOWN[low]).tolist()
                    for group, a, b, end, key in zip(groups.view(np.int64).tolist(), low.tolist(), high.tolist(), ends.tolist(), hashes):
                        place = (ids[i], digests[i], base + a)
                        known = seen.setdefault((group, key, b - a), place)
                        # Rows that repeat id and text are settled with the texts.
                        if known == place:
                            out.append((group, ids[i], digests[i], base + a, base + b, piece[a:end].tobytes()))
                        else:
                            out.append((ids[i] ^ digests[i], ids[i], digests[i], base + a, base + b, None))
            if out:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*out), _TYPES)), _NAMES)

    return find


def _bands(low, high, at, names, burning, sums):
    """Contexts of hot anchors cut into bands of offsets, grouped by their common bytes."""
    parts = [(low[~burning], high[~burning], at[~burning], names[~burning], names[~burning])]
    low, high, at, names = low[burning], high[burning], at[burning], names[burning]
    for band in range(-(-REACH // BAND)):
        near = band * BAND
        a, b = np.maximum(low, at - near - BAND + 1), np.minimum(high, at - near)
        own = a <= b
        core = at[own] - near
        size = LENGTH - BAND + 1
        common = mix((sums[core + size] - sums[core]) * _DOWN[core])
        groups = mix(common ^ mix(names[own] + np.uint64(band + 1)))
        parts.append((a[own], b[own], at[own], names[own], groups))
    return (np.concatenate(column) for column in zip(*parts))


REPEATS = "id long, digest long, low int, high int"


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts of windows that have an earlier equal one, as ranges, from contexts sorted by group and text."""
    block: list[tuple[int, int, int, int, int, bytes]] = []
    out: list[tuple[int, int, int, int]] = []

    def flush():
        texts = [row[5] for row in block]
        order, same = equal_windows(texts)
        starts = np.cumsum([0, *map(len, texts)])
        row = np.searchsorted(starts, order, side="right") - 1
        # A window is named by its document's rank and its start there: contexts overlap.
        docs = {key: i for i, key in enumerate(sorted({line[1:3] for line in block}))}
        rank = np.array([docs[line[1:3]] for line in block])
        lows = np.array([line[3] for line in block])
        run = np.cumsum(~same) - 1
        place = (rank[row] << 32) + lows[row] + order - starts[row]
        first = np.full(run[-1] + 1, np.iinfo(np.int64).max) if len(run) else np.zeros(0, np.int64)
        np.minimum.at(first, run, place)
        later = place > first[run]
        row, start = row[later], (order - starts[row])[later]
        by = np.lexsort((start, row))
        row, start = row[by], start[by]
        if len(row):
            cut = np.flatnonzero((row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)) + 1
            for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(row)]]).tolist()):
                _, id_, digest, low, _, _ = block[row[a]]
                out.append((id_, digest, low + int(start[a]), low + int(start[b - 1])))
        block.clear()

    # A context alone in its group has no other window of its anchor to equal.
    group, first, last, lone, size = None, None, None, 0, 0
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[5] is None:
                out.append(row[1:5])
                continue
            if row[0] != group:
                if lone == 1:
                    size -= len(block.pop()[5])
                lone = 0
                if size > SORT_BYTES:
                    flush()
                    size = 0
                group, last = row[0], None
            if row[5] == last:
                # Sorted by place within equal contexts, so the one before is earlier, or
                # the same place of a row that is repeated.
                if row[1:4] != first:
                    out.append(row[1:5])
                continue
            first, last = row[1:4], row[5]
            lone += 1
            size += len(last)
            block.append(row)
        if out:
            yield _ranges(out)
            out.clear()
    if lone == 1:
        block.pop()
    if block:
        flush()
    if out:
        yield _ranges(out)


def _ranges(rows: list) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), types)), ["id", "digest", "low", "high"])


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def kept_parts(size: int, ranges: list[tuple[int, int]], all_of_it: bool) -> list[tuple[int, int]]:
    """The removed runs of bytes, from ranges of starts."""
    if all_of_it and size >= LENGTH:
        return [(0, size)]
    runs: list[list[int]] = []
    for low, high in sorted(ranges):
        if runs and low <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], high + LENGTH)
        else:
            runs.append([low, high + LENGTH])
    return [(a, b) for a, b in runs]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64()] * 4 + [pa.string()]
    for batch in whole_batches(batches, BLOCK_BYTES):
        rows = []
        columns = (batch.column(name).to_pylist() for name in ("doc_id", "text", "ranges", "turn"))
        for doc_id, text, ranges, turn in zip(*columns):
            data = text.encode("utf-8")
            runs = kept_parts(len(data), [(r["low"], r["high"]) for r in ranges or ()], turn > 1)
            kept, done = hashlib.sha256(), 0
            for a, b in runs:
                kept.update(data[done:a])
                done = b
            kept.update(data[done:])
            rows.append((doc_id, len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
        yield pa.RecordBatch.from_arrays(
            list(map(pa.array, zip(*rows), types)), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def remove_repeats(docs: DataFrame, scratch=None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs``."""
    scratch = scratch or scratch_of(docs)
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(LAST_ID)).cast("long").alias("id"),
        F.xxhash64(text).alias("digest"),
        text.alias("text"),
    )
    long_enough = keyed.select("id", "digest", "text").where(F.octet_length("text") >= LENGTH)
    again = scratch.save(
        long_enough.select("text")
        .mapInArrow(_count_anchors, "anchor long, n long")
        .groupBy("anchor")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > 1),
        "anchors",
    )
    hashes = again.withColumnRenamed("anchor", "key")
    twice, hot = HashFilter(hashes, BITS), HashFilter(hashes.where(F.col("n") > HOT), BITS)
    repeats = (
        long_enough.mapInArrow(_contexts(twice, hot), CONTEXTS)
        .repartition(width, "group")
        .sortWithinPartitions("group", "context", "id", "digest", "low")
        .mapInArrow(_repeats, REPEATS)
    )
    ranges = repeats.groupBy("id", "digest").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    turn = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.lit(0)))
    return (
        keyed.join(ranges, ["id", "digest"], "left")
        .select("doc_id", "text", "ranges", turn.alias("turn"))
        .mapInArrow(_cut, SCHEMA)
    )
