"""SimHash fingerprints, and all of them within a Hamming radius.

Each shingle of ``SHINGLE`` lower-case words votes on every bit with the sign of
its hash there, weighted by one plus the logarithm of its count. A fingerprint
has ``BITS`` bits, written in hex.

``within_radius`` finds all fingerprints that differ from a query in ``radius``
bits at most: cut into ``radius`` + 1 blocks, two such must agree in a whole
block. So there is one table per block, keyed by the block's value (the bits
permuted so that this block leads), and what agrees is verified. Equal
fingerprints are one row with a count, so copies do not multiply.

``fingerprint_edits`` needs each document's successor in descending id order.
Documents are dealt by ranges of ids and walked in order within a range; the
first document of each range is sent to the range before as well. Texts are
shuffled once, and a task holds two texts at a time besides what Spark sorts.

Defined results: a null text is an empty one, whose fingerprint has no bit set;
a text shorter than a shingle is one shingle; equal texts have equal
fingerprints; rows of equal ids follow each other by text; a null id comes last;
a single document is its own successor; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import whole_batches
from tidefold.llm.ranges import shard_bounds, shard_of

BITS = 128
SHINGLE = 3
RADIUS = 3
KNOWN_WORDS = 300_000
BLOCK_BYTES = 8 << 20
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


class SimHash:
    """Fingerprints as packed bytes; word hashes are kept between texts."""

    def __init__(self):
        self.hashes = _WordHashes()

    def __call__(self, text: str) -> bytes:
        words = text.lower().split()
        if not words:
            return bytes(BITS // 8)
        if len(self.hashes) > KNOWN_WORDS:
            self.hashes.clear()
        codes = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        width = max(1, len(codes) - SHINGLE + 1)
        terms = np.zeros(width, np.uint64)
        for i in range(min(SHINGLE, len(codes))):
            terms = (terms + codes[i : i + width]) * _MIX[i]
            terms ^= terms >> np.uint64(31)
        terms, counts = np.unique(terms, return_counts=True)
        weights = (1 + np.log(counts)).astype(np.float32)
        other = (terms ^ (terms >> np.uint64(29))) * _MIX[1]
        other ^= other >> np.uint64(32)
        bits = np.unpackbits(np.stack([terms, other], 1).view(np.uint8), axis=1)
        votes = 2 * (weights @ bits.astype(np.float32)) - weights.sum()
        return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of bits that agree."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    simhash, before = SimHash(), None
    for batch in whole_batches(batches, BLOCK_BYTES):
        out = []
        for doc_id, text, shard, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_shard", "_tail"))):
            text = text or ""
            own = simhash(text) if before or not tail else b""
            if before:
                n = len(before[1])
                edited = before[1][: n - n // 3] + text[: n // 3]
                changed = simhash(edited)
                digest = hashlib.sha256(edited.encode("utf-8")).hexdigest()
                fp = before[2]
                out.append((before[0], n, digest, fp.hex(), changed.hex(), likeness(fp, changed), likeness(fp, own)))
            # After a range's tail, or the rows of equal id behind it, a new range begins.
            before = None if tail else (doc_id, text, own)
        columns = list(zip(*out)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, types)), names)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how near they are.

    The edit replaces the last third of the characters by the first as many of
    the next document's, in descending order of id, the first following the last.
    """
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = shard_bounds(docs, "doc_id", 3 * width)
    dealt = docs.select("doc_id", "text", shard_of("doc_id", bounds, descending=True).alias("_shard"))
    # The greatest id of each range that has rows: one row per range.
    firsts = sorted(
        (row["_shard"], row["first"]) for row in dealt.groupBy("_shard").agg(F.max("doc_id").alias("first")).collect()
    )
    earlier = {shard: firsts[i - 1][0] for i, (shard, _) in enumerate(firsts)}
    back = F.lit(None).cast("int")
    if firsts:
        to = F.create_map(*(F.lit(x) for shard, first in firsts for x in (shard, earlier[shard])))
        leads = F.array(*(F.lit(first).cast("long") for _, first in firsts))
        lead = F.element_at(leads, F.element_at(
            F.create_map(*(F.lit(x) for i, (shard, _) in enumerate(firsts, 1) for x in (shard, i))), F.col("_shard")
        ))
        back = F.when(F.col("doc_id").eqNullSafe(lead), F.element_at(to, F.col("_shard")))
    places = F.array(
        F.struct(F.col("_shard"), F.lit(False).alias("_tail")), F.struct(back.alias("_shard"), F.lit(True).alias("_tail"))
    )
    return (
        dealt.select("doc_id", "text", F.explode(places).alias("_place"))
        .select("doc_id", "text", "_place.*")
        .where(F.col("_shard").isNotNull())
        .repartition(width, "_shard")
        .sortWithinPartitions("_shard", "_tail", F.col("doc_id").desc_nulls_last(), "text")
        .mapInArrow(_walk, SCHEMA)
    )


def within_radius(fingerprints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``query, fingerprint, rows, distance``: rows of ``fingerprints`` (a column of
    that name, hex) within ``radius`` bits of each distinct one of ``queries``."""
    digits = BITS // 4
    cuts = [i * digits // (radius + 1) for i in range(radius + 2)]
    blocks = lambda column: F.posexplode(
        F.array(*(F.substring(column, a + 1, b - a) for a, b in zip(cuts, cuts[1:])))
    ).alias("_table", "_block")
    rows = fingerprints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("rows"))
    asked = queries.select(F.col("fingerprint").alias("query")).distinct()
    pairs = (
        rows.select("fingerprint", "rows", blocks("fingerprint"))
        .join(asked.select("query", blocks("query")), ["_table", "_block"])
    )
    half = lambda column, at: F.conv(F.substring(column, at, 8), 16, 10).cast("long")
    distance = sum(
        F.bit_count(half("query", at).bitwiseXOR(half("fingerprint", at))) for at in range(1, digits + 1, 8)
    )
    return (
        pairs.withColumn("distance", distance)
        .where(F.col("distance") <= radius)
        .select("query", "fingerprint", "rows", "distance")
        .distinct()
    )
