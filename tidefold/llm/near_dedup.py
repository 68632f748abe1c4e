"""Near-duplicate classes by ProbMinHash sketches.

Each five-word shingle of a text is an element, weighted by one plus the
logarithm of its count. Elements arrive at random registers as Poisson processes
with their weight as the rate; a register keeps the earliest. An element's
process ends once its next arrival is later than every register's, so only a few
arrivals per element are drawn. The share of equal registers estimates the
probability Jaccard of two texts (the plain one where weights are equal).

Equal texts are one node. Registers are banded; a bucket is the nodes that share
a band. First each node of a bucket is compared with one node only, that which
meets the most others in all its buckets: a text that many are copies of is nearer
to them than they are to each other. These pairs are held to the exact Jaccard of their
shingle sets, at ``SIMILARITY``, as all others are. What is then linked needs no further comparison: in buckets whose nodes still lie in several
components, those outside the largest are compared with the nodes of other
components, exactly and in blocks of ``CHUNK`` nodes, by the matrix product of
their sets; only links leave the task. A pair that shares a bucket is so either
compared or already in one class, and a group of copies that link costs its size,
not its square. What costs more is a group of many texts just below the
similarity: those of its nodes that link to nothing are compared with all of it.

At similarity 0.8 a pair shares no band with probability 0.00003 (26 bands of 5).

Defined results: null text equals empty text; texts without words are near equal
ones alone; a text under five words is one shingle; a class is named by the least
doc_id of its rows and the digest of that row's text (null ids do not count; null and
its own digest where all are null), so classes stay apart where ids repeat; repeated
rows come out each; an empty table gives no rows; other columns are not looked
at. Very long texts are one row's work each, in memory that follows the longest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.llm.common import HashFilter, free_name, scratch_of, whole_batches
from tidefold.llm.shingles import mix, shingle_codes, split
from tidefold.operators.components import components

SIMILARITY = 0.8
BANDS, BAND_SIZE = 26, 5
REGISTERS = BANDS * BAND_SIZE
BLOCK_BYTES = 2 << 20
# Nodes of a bucket that are compared with as many others in one task, and shingles
# that are columns of the matrix product at a time.
CHUNK, COLUMNS = 1024, 4096
_TURN = 0x9E3779B97F4A7C15
DIGEST_BYTES = 16


def prob_minhash(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The element (64-bit hashes, distinct) that arrives first at each register."""
    earliest = np.full(registers, np.inf)
    winner = np.zeros(registers, np.uint64)
    live, times, state, rates, turn = elements, 0.0, elements, 1 / weights, 0
    while len(live):
        turn = (turn + _TURN) & 0xFFFFFFFFFFFFFFFF
        draw = mix(state + np.uint64(turn))
        uniform = ((draw >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53
        times = times - np.log(uniform) * rates
        at = (mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, at, times)
        first = times == earliest[at]
        winner[at[first]] = live[first]
        on = times < earliest.max()
        live, times, state, rates = live[on], times[on], state[on], rates[on]
    return winner


def weighted(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    elements, counts = np.unique(shingles, return_counts=True)
    return elements, 1 + np.log(counts)


def band_keys(winner: np.ndarray) -> np.ndarray:
    keys = np.zeros(BANDS, np.uint64)
    for part in winner.reshape(BANDS, BAND_SIZE).T:
        keys = mix(keys * np.uint64(_TURN) + part)
    return keys


SKETCH = "doc_id long, digest binary, keys array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.binary(), pa.list_(pa.int64())]
    for batch in whole_batches(batches, BLOCK_BYTES):
        ids, texts, rows = batch.column("doc_id").to_pylist(), batch.column("text"), []
        for doc_id, text, shingles in zip(ids, texts.to_pylist(), split(*shingle_codes(texts))):
            digest = _digest(text)
            if len(shingles):
                winner = prob_minhash(*weighted(shingles))
                rows.append((doc_id, digest, band_keys(winner).view(np.int64)))
            else:
                rows.append((doc_id, digest, None))
        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), types)), ["doc_id", "digest", "keys"])


@F.pandas_udf(T.DoubleType())
def exact_jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    found = []
    for x, y in zip(a, b):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        found.append(both / (len(x) + len(y) - both))
    return pd.Series(found, dtype=float)


def _sets_of(asked: HashFilter):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_batches(batches, BLOCK_BYTES):
            batch = batch.filter(pa.array(asked(batch.column("_key").to_numpy().view(np.uint64))))
            texts = batch.column("text")
            own = [np.unique(s).tobytes() for s in split(*shingle_codes(texts))]
            digests = [_digest(text) for text in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(own, pa.binary())],
                ["doc_id", "digest", "shingles"],
            )

    return sets


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``a, b`` pairs with the column of both nodes."""
    of = lambda side: table.select(F.col("node").alias(side), F.col(column).alias(f"{column}_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b")


def _digest(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode("utf-8")).digest()[:DIGEST_BYTES]


def _shingle_sets(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``node, shingles`` of the nodes that share a bucket; texts are not shuffled."""
    asked = members.select("node").distinct().join(nodes.select("node", F.col("first_id").alias("doc_id"), "digest"), "node")
    shared = HashFilter(asked.select(F.xxhash64("doc_id").alias("key")))
    found = (
        docs.where(F.col("doc_id").isNotNull())
        .withColumn("_key", F.xxhash64("doc_id"))
        .mapInArrow(_sets_of(shared), "doc_id long, digest binary, shingles binary")
    )
    # Rows that repeat an id and text are the same node; one is enough.
    return found.join(asked, ["doc_id", "digest"]).dropDuplicates(["node"]).select("node", "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, scratch, name: str) -> DataFrame:
    """Of ``a, b`` candidates those at ``SIMILARITY``, as ``src, dst``."""
    linked = _both(pairs, sets, "shingles").where(exact_jaccard("shingles_a", "shingles_b") >= SIMILARITY)
    return scratch.save(linked.select(F.col("a").alias("src"), F.col("b").alias("dst")), f"linked-{name}")


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets, each of ``left`` with each of ``right``."""
    sets = left + right
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Elements of one set alone are in no intersection; the others are numbered anew.
    number = np.cumsum(uses > 1) - 1
    shared = uses[column] > 1
    row, column = row[shared], number[column[shared]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    found = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(number[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        matrix = np.zeros((len(sets), min(COLUMNS, int(number[-1]) + 1 - at)), np.float32)
        matrix[row[a:b], column[a:b] - at] = 1
        found += matrix[: len(left)] @ matrix[len(left) :].T
    return found


def _block_links(outside: list[tuple], inside: list[tuple]) -> set[tuple[int, int]]:
    """One link of each node of ``outside`` to each other part of ``inside`` that it is similar to."""
    left, right = ([np.frombuffer(r[2], np.uint64) for r in rows] for rows in (outside, inside))
    both = _intersections(left, right)
    total = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    linked = both >= SIMILARITY * (total - both) - 1e-3
    linked &= np.array([r[1] for r in outside])[:, None] != np.array([r[1] for r in inside])[None, :]
    found = {}
    for i, j in zip(*(at.tolist() for at in np.nonzero(linked))):
        # Of whole numbers, exactly; the product above is of single precision.
        if both[i, j] / (total[i, j] - both[i, j]) >= SIMILARITY:
            found[outside[i][0], inside[j][1]] = (outside[i][0], inside[j][0])
    return set(found.values())


def _links_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of blocks; rows come sorted by block."""
    block, rows = None, ([], [])
    names = ("band", "key", "left", "right", "outside", "node", "part", "shingles")

    def links():
        found = sorted(_block_links(*rows)) if rows[0] and rows[1] else []
        rows[0].clear()
        rows[1].clear()
        return found

    for batch in batches:
        out = []
        for row in zip(*(batch.column(name).to_pylist() for name in names)):
            if row[:4] != block:
                out += links()
                block = row[:4]
            rows[0 if row[4] else 1].append(row[5:])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["src", "dst"])
    if out := links():
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["src", "dst"])


def _rest_linked(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between parts of one bucket, of its nodes outside the largest part."""
    width = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = F.expr(f"cast((rows - 1) div {CHUNK} as int)")
    own = F.pmod(F.xxhash64("node"), chunks + 1).cast("int")
    every = F.sequence(F.lit(0), chunks)
    columns = ["band", "key", "node", "part"]
    inside = mixed.select(*columns, F.lit(False).alias("outside"), own.alias("right"), F.explode(every).alias("left"))
    outside = mixed.where(F.col("part") != F.col("largest")).select(
        *columns, F.lit(True).alias("outside"), own.alias("left"), F.explode(every).alias("right")
    )
    block = ["band", "key", "left", "right"]
    dealt = outside.unionByName(inside).join(sets, "node").repartition(width, *block).sortWithinPartitions(*block)
    return dealt.mapInArrow(_links_in_blocks, "src long, dst long").distinct()


def near_classes(docs: DataFrame, scratch=None) -> DataFrame:
    """``doc_id, class_id, class_digest, copies, class_texts`` per row: its class, the
    rows of the same text, and how many different texts the class has."""
    return _classes(docs, scratch or scratch_of(docs)).drop("digest")


def _classes(docs: DataFrame, scratch) -> DataFrame:
    """The same, with the ``digest`` of each row's text."""
    docs = docs.select("doc_id", "text")
    sketches = scratch.save(docs.mapInArrow(_sketch, SKETCH), "sketches")
    nodes = scratch.save(
        sketches.groupBy("digest")
        .agg(
            F.min("doc_id").alias("first_id"),
            F.count(F.lit(1)).alias("copies"),
            F.first("keys").alias("keys"),
        )
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    # Texts whose rows have no id cannot be found again and stay alone.
    banded = nodes.where(F.col("first_id").isNotNull()).select("node", F.posexplode("keys").alias("band", "key"))
    sizes = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    shared = scratch.save(banded.join(sizes, ["band", "key"]), "shared")
    # The text that others are copies of shares more bands with them than they do with
    # each other: compared with it, most of a group links at once.
    met = shared.groupBy("node").agg(F.sum("size").alias("met"))
    ranked = shared.join(met, "node")
    hubs = ranked.groupBy("band", "key").agg(F.max_by("node", F.struct("met", "node")).alias("hub"))
    members = scratch.save(shared.join(hubs, ["band", "key"]), "members")
    stars = scratch.save(
        members.where(F.col("node") != F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(),
        "stars",
    )
    sets = scratch.save(_shingle_sets(docs, nodes, members), "sets")
    first = _verified(stars, sets, scratch, "stars")
    labels = components(first, scratch, "first")
    placed = members.where(F.col("size") > 2).join(labels, "node", "left").select(
        "band", "key", "node", F.coalesce("component", "node").alias("part")
    )
    parts = placed.groupBy("band", "key", "part").agg(F.count(F.lit(1)).alias("rows"))
    largest = (
        parts.groupBy("band", "key")
        .agg(
            F.max_by("part", F.struct("rows", "part")).alias("largest"),
            F.count(F.lit(1)).alias("parts"),
            F.sum("rows").alias("rows"),
        )
        .where(F.col("parts") > 1)
        .drop("parts")
    )
    mixed = placed.join(largest, ["band", "key"])
    second = scratch.save(_rest_linked(mixed, sets), "linked-rest")
    edges = first.union(second)
    classes = components(edges, scratch, "all")
    named = nodes.select("node", "digest", "first_id", "copies").join(classes, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "digest")))
    names = named.groupBy("component").agg(
        least.alias("least"), F.min("digest").alias("any"), F.count(F.lit(1)).alias("class_texts")
    ).select(
        "component",
        F.col("least.first_id").alias("class_id"),
        F.lower(F.hex(F.coalesce("least.digest", "any"))).alias("class_digest"),
        "class_texts",
    )
    of_text = named.join(names, "component").select("digest", "class_id", "class_digest", "copies", "class_texts")
    classed = sketches.select("doc_id", "digest").join(of_text, "digest")
    return classed.select("doc_id", "digest", "class_id", "class_digest", "copies", "class_texts")


def one_of_each(docs: DataFrame, scratch=None) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each class the row of least id and
    its text (of rows that repeat both, one, the same in every run); rows without an id stay."""
    scratch = scratch or scratch_of(docs)
    own, times = free_name(docs, "own_digest"), free_name(docs, "own_times")
    leads = (F.col("doc_id") == F.col("class_id")) & (F.lower(F.hex("digest")) == F.col("class_digest"))
    keep = (
        _classes(docs.where(F.col("doc_id").isNotNull()), scratch)
        .where(leads)
        .groupBy("doc_id", F.col("digest").alias(own))
        .agg(F.count(F.lit(1)).alias(times))
    )
    digest = F.substring(F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)), 1, DIGEST_BYTES)
    kept = docs.where(F.col("doc_id").isNotNull()).withColumn(own, digest).join(keep, ["doc_id", own])
    once = kept.where(F.col(times) == 1).select(*docs.columns)
    # Combined before the shuffle, however often a row is repeated.
    row = F.struct(*docs.columns)
    repeated = kept.where(F.col(times) > 1).groupBy("doc_id", own).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("_row"))
    unnamed = docs.where(F.col("doc_id").isNull())
    return once.unionByName(repeated.select("_row.*")).unionByName(unnamed)
