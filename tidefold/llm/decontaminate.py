"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size: class U holds items of more than U / 2 and
at most U shingles (9 to 16 in the least). For each class in use a document is
cut into windows of 2 U shingles, U apart, so that an item's passage lies whole in one
of them and makes up a known share of it, however long the document is. Windows and
items have ``SLOTS`` MinHash values; a window that shares one with an item of its class
makes document and item a candidate. An item that a window contains to 0.8 has a
Jaccard of 0.19 with it at least, so one value in 64 is shared but for one case in
a million. Items of up to ``FEW`` shingles are a class of their own, searched among all
of a document's shingles by their least hashes, one more than may be missing: one of
them must be there. An item under five words is one shingle of as many words as it has,
looked for among the runs of that many words. Candidates are verified by the exact share of
the item's shingles that the document has, over its whole text.

Items are joined by key, never broadcast. A bitmap sized by the number of their keys
(up to 2^28 bits) keeps documents without any from being written at all; documents
with some carry their shingles along, so texts are not shuffled. An item that
very many documents hold is a skewed side of a join, which Spark splits.

Defined results: null texts are empty; a text without words neither contains nor
is contained; equal items are searched as one and named each, an item without an id
by null; documents that repeat come out each, by their ids or null; an empty table on
either side gives no rows; other columns are not looked at. Very long texts are
searched whole, in memory that follows the longest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.llm.common import HashFilter, free_name, scratch_of, whole_batches
from tidefold.llm.shingles import WORDS, mix, shingle_codes, split, word_codes

CONTAINMENT = 0.8
SLOTS = 64
# Items up to this many shingles are one class; the next classes double it.
LEAST_CLASS = 16
# Items of no more shingles are searched by shingles themselves, as a class of this name.
FEW = 8
EXACT = 1 << 8
BLOCK_BYTES = 1 << 20
_ODD = mix(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)
_ITEMS = "item_id long, shingles array<long>, size int, width int, keys array<long>"
# Bits of the bitmap: so many per key, between these bounds.
BITS_PER_KEY, LEAST_BITS, MOST_BITS = 32, 1 << 24, 1 << 28


def size_class(size: int) -> int:
    """The number of doublings of ``LEAST_CLASS`` that hold ``size``."""
    return max(0, (size - 1).bit_length() - (LEAST_CLASS - 1).bit_length())


def _keys(values: np.ndarray, size: int, slot: int) -> np.ndarray:
    """One number per class, slot and MinHash value."""
    return mix(values ^ mix(np.array([(size << 16) + slot + 1], np.uint64)))


def _items(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    for batch in whole_batches(batches, BLOCK_BYTES):
        rows, texts = [], batch.column("text")
        # Runs of as many words as the shortest texts have, for these.
        widths = np.minimum(np.diff(word_codes(texts)[1]), WORDS).tolist()
        runs = {width: split(*shingle_codes(texts, width)) for width in {WORDS, *widths} if width}
        for i, (item_id, width) in enumerate(zip(batch.column("item_id").to_pylist(), widths)):
            if not width:
                continue
            shingles = runs[width][i]
            own, size = np.unique(shingles), size_class(len(shingles))
            if len(own) <= FEW:
                # One of these is there, or more are missing than may be.
                missing = int(len(own) * (1 - threshold) + 1e-9)
                size, keys = EXACT, _keys(own[: missing + 1], EXACT, width)
            else:
                keys = [_keys((own * a).min(keepdims=True), size, i)[0] for i, a in enumerate(_ODD)]
            rows.append((item_id, own.view(np.int64), size, width, np.array(keys, np.uint64).view(np.int64)))
        if rows:
            yield pa.RecordBatch.from_arrays(
                list(map(pa.array, zip(*rows), types)), ["item_id", "shingles", "size", "width", "keys"]
            )


def window_keys(shingles: np.ndarray, places: np.ndarray, sizes: list[int]):
    """For each class and slot: the rows of the windows, and their keys.

    Blocks of the least class are merged in pairs for each next one; a window is
    a block and the one behind it in the same document.
    """
    counts = np.diff(places)
    blocks = -(-counts // LEAST_CLASS)
    row = np.repeat(np.arange(len(counts)), blocks)
    first = np.concatenate([[0], np.cumsum(blocks)])
    starts = np.repeat(places[:-1], blocks) + (np.arange(first[-1]) - np.repeat(first[:-1], blocks)) * LEAST_CLASS
    merges = [(row, None)]
    for _ in range(max(sizes)):
        own, number = merges[-1][0], np.zeros(0, np.int64)
        head = np.concatenate([[True], own[1:] != own[:-1]])
        at = np.flatnonzero(head)
        number = np.arange(len(own)) - np.repeat(at, np.diff(np.append(at, len(own))))
        keep = np.flatnonzero(number % 2 == 0)
        merges.append((own[keep], keep))
    for slot, odd in enumerate(_ODD):
        least = np.minimum.reduceat(shingles * odd, starts)
        for size in range(max(sizes) + 1):
            own, keep = merges[size]
            if keep is not None:
                least = np.minimum.reduceat(least, keep)
            if size in sizes:
                window = least.copy()
                same = own[1:] == own[:-1]
                window[:-1][same] = np.minimum(least[:-1], least[1:])[same]
                yield own, _keys(window, size, slot)


SUSPECTS = "doc_id long, digest binary, keys array<long>, shingles binary"


def _suspects(known: HashFilter, sizes: list[int], widths: list[int]):
    """Documents with a key that may be an item's, with these keys and all their shingles."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
        for batch in whole_batches(batches, BLOCK_BYTES):
            texts = batch.column("text")
            shingles, places = shingle_codes(texts)
            if not len(shingles):
                continue
            # reduceat needs a shingle in every block: rows without any are left out.
            full = np.flatnonzero(np.diff(places))
            kept = np.concatenate([[0], places[1:][full]])
            found: dict[int, set] = {}
            # Shorter runs of words that may be an item are kept beside the shingles.
            short: dict[int, list] = {}

            def add(own, keys, hit):
                for i, key in zip(own[hit].tolist(), keys[hit].view(np.int64).tolist()):
                    found.setdefault(i, set()).add(key)

            if sizes:
                for own, keys in window_keys(shingles, kept, sizes):
                    add(own, keys, np.flatnonzero(known(keys)))
            for width in widths:
                codes, begin = (shingles, places) if width == WORDS else shingle_codes(texts, width)
                own = np.repeat(np.arange(len(full)), np.diff(begin)[full])
                keys = _keys(codes, EXACT, width)
                hit = np.flatnonzero(known(keys))
                add(own, keys, hit)
                if width < WORDS:
                    for i, code in zip(own[hit].tolist(), codes[hit].tolist()):
                        short.setdefault(i, []).append(code)
            ids, listed = batch.column("doc_id").to_pylist(), texts.take(pa.array(full[sorted(found)])).to_pylist()
            rows = []
            for (i, keys), text in zip(sorted(found.items()), listed):
                codes = np.concatenate((shingles[kept[i] : kept[i + 1]], np.array(short.get(i, []), np.uint64)))
                rows.append((ids[full[i]], text_digest(text), sorted(keys), np.unique(codes).tobytes()))
            if rows:
                names = [part.split()[0] for part in SUSPECTS.split(", ")]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), types)), names)

    return find


def text_digest(text: str | None) -> bytes:
    return hashlib.sha256((text or "").encode("utf-8")).digest()


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _containments(shingles: pd.Series, items: pd.Series) -> pd.Series:
    """For each of a document's candidate items, the share of its shingles that the document has."""
    found = []
    for own, asked in zip(shingles, items):
        own = np.frombuffer(own, np.uint64)
        shares = []
        for item in asked:
            item = np.asarray(item, np.int64).view(np.uint64)
            at = np.minimum(np.searchsorted(own, item), len(own) - 1)
            shares.append(float((own[at] == item).mean()))
        found.append(shares)
    return pd.Series(found)


def _contained(docs: DataFrame, benchmark: DataFrame, threshold: float, scratch) -> DataFrame:
    """``doc_id, digest, item_id, containment``, and the digest of the document's text."""
    listed = scratch.save(benchmark.select("item_id", "text").mapInArrow(partial(_items, threshold=threshold), _ITEMS), "items")
    kind = ["shingles", "size", "width"]
    items = listed.groupBy(*kind).agg(F.first("keys").alias("keys"))
    items = scratch.save(items.withColumn("item", F.monotonically_increasing_id()), "different-items")
    members = listed.join(items.select(*kind, "item"), kind).select("item", "item_id")
    keys = items.select("item", F.explode("keys").alias("key"))
    # One row per class, and for the smallest one per number of words.
    classes = [tuple(row) for row in items.select("size", "width").distinct().collect()]
    if not classes:
        return docs.sparkSession.createDataFrame([], "doc_id long, digest binary, item_id long, containment double")
    sizes = sorted({size for size, _ in classes if size != EXACT})
    widths = sorted({width for size, width in classes if size == EXACT})
    bits = 1 << (BITS_PER_KEY * keys.count()).bit_length()
    known = HashFilter(keys, min(MOST_BITS, max(LEAST_BITS, bits)))
    suspects = docs.select("doc_id", "text").mapInArrow(_suspects(known, sizes, widths), SUSPECTS)
    suspects = scratch.save(suspects.withColumn("row", F.monotonically_increasing_id()), "suspects")
    pairs = suspects.select("row", F.explode("keys").alias("key")).join(keys, "key").select("row", "item").distinct()
    asked = (
        pairs.join(items.select("item", "shingles"), "item")
        .groupBy("row")
        .agg(F.collect_list(F.struct("item", "shingles")).alias("items"))
    )
    checked = suspects.join(asked, "row").select(
        "doc_id",
        "digest",
        F.explode(
            F.arrays_zip(
                F.col("items.item").alias("item"),
                _containments("shingles", F.col("items.shingles")).alias("containment"),
            )
        ).alias("found"),
    )
    found = checked.select("doc_id", "digest", "found.item", "found.containment").where(F.col("containment") >= threshold)
    return found.join(members, "item").drop("item")


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = CONTAINMENT, scratch=None) -> DataFrame:
    """``doc_id, item_id, containment``: items whose shingles a document has to ``threshold`` or more."""
    found = _contained(docs, benchmark, threshold, scratch or scratch_of(docs))
    return found.select("doc_id", "item_id", "containment")


def clean_documents(docs: DataFrame, benchmark: DataFrame, scratch=None) -> DataFrame:
    """Rows of ``docs`` whose text contains no item, whatever their ids."""
    found = _contained(docs, benchmark, CONTAINMENT, scratch or scratch_of(docs))
    own = free_name(docs, "own_digest")
    named = docs.withColumn(own, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    return named.join(found.select(F.col("digest").alias(own)).distinct(), own, "left_anti").select(*docs.columns)
