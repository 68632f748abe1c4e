"""A ledger bucketed by hash, joined where it lies, with a filter that tells new contents.

The ledger's files are cut by hash into a fixed number of buckets and sorted within, so
that a lookup moves its own rows alone: the ledger side of the join has no exchange. The
number of buckets is part of the folder's name and cannot be mistaken later.

Beside it lies a blocked Bloom filter per bucket: eight words of 64 bits, one bit set in
each, per ``ROWS_PER_BLOCK`` contents or so. It is a table too, about a hundredth of the
ledger, to which each append adds its bits. Contents that it does not know are new and
take no part in the lookup; if only few are left, their hashes reach the ledger's scan
and it skips buckets and row groups. A filter that was laid out too small lets more
through, and changes nothing else.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold import schemas
from tidefold.sources.journal import read_or_empty

ROWS_PER_BLOCK = 48
WORDS = 8
# So many hashes at most are handed to the scan as a list.
FEW_HASHES = 2_000

_FOLDER = re.compile(r"hash-buckets-(\d+)-blocks-(\d+)\Z")
_BITS = "block bigint, " + ", ".join(f"w{i} bigint" for i in range(WORDS))


def _children(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in system.listStatus(path)] if system.exists(path) else []


@dataclass(frozen=True)
class BucketedLedger:
    """A ledger below ``folder``, in ``buckets`` by hash, with ``blocks`` of filter per bucket."""

    spark: SparkSession
    folder: str
    buckets: int
    blocks: int

    @property
    def _root(self) -> str:
        return f"{self.folder.rstrip('/')}/hash-buckets-{self.buckets}-blocks-{self.blocks}"

    @property
    def _table(self) -> str:
        """Known to the session's catalog under a name made from its place."""
        name = f"tidefold_ledger_{hashlib.md5(self._root.encode()).hexdigest()}"
        columns = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in schemas.LEDGER.fields)
        place = f"{self._root}/rows".replace("'", "''")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            f"CLUSTERED BY (hash) SORTED BY (hash) INTO {self.buckets} BUCKETS LOCATION '{place}'"
        )
        return name

    def rows(self) -> DataFrame:
        """The ledger as it is now."""
        self.spark.catalog.refreshTable(self._table)
        return self.spark.table(self._table)

    def append(self, rows: DataFrame) -> None:
        """Add rows that are new by content: one file per bucket, then their bits.

        Bits first: a content in the filter only costs a lookup, one that is only in the
        ledger would be taken for new.
        """
        rows = rows.select(*schemas.LEDGER.names)
        self._bits_of(rows).write.mode("append").parquet(f"{self._root}/bits")
        rows.repartition(self.buckets, "hash").write.insertInto(self._table)

    def _block(self, key: Column) -> Column:
        """A block of the bucket that the hash falls in."""
        bucket = F.pmod(F.hash(key), F.lit(self.buckets)).cast("bigint")
        return bucket * self.blocks + F.pmod(F.xxhash64(key), F.lit(self.blocks))

    def _masks(self, key: Column) -> list[Column]:
        seed = F.xxhash64(key, F.lit("bits"))
        one = F.lit(1).cast("bigint")
        at = [F.shiftrightunsigned(seed, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]
        return [F.call_function("shiftleft", one, place) for place in at]

    def _bits_of(self, rows: DataFrame) -> DataFrame:
        known = rows.where(F.col("hash").isNotNull())
        words = [F.bit_or(mask).alias(f"w{i}") for i, mask in enumerate(self._masks(F.col("hash")))]
        return known.groupBy(self._block(F.col("hash")).alias("block")).agg(*words)

    def bits(self) -> DataFrame:
        """One row per block, the bits of all appends together."""
        written = read_or_empty(self.spark, f"{self._root}/bits", _BITS)
        return written.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))

    def maybe_known(self, hashes: DataFrame) -> DataFrame:
        """The rows of ``hash`` that the filter does not tell to be new."""
        hit = F.lit(True)
        for i, mask in enumerate(self._masks(F.col("hash"))):
            hit = hit & (F.col(f"w{i}").bitwiseAND(mask) != 0)
        asked = hashes.where(F.col("hash").isNotNull()).withColumn("block", self._block(F.col("hash")))
        return asked.join(self.bits(), "block").where(hit).select(*hashes.columns)

    def known_among(self, rows: DataFrame, few: int = FEW_HASHES) -> DataFrame:
        """``hash, dest_path`` of the contents of ``rows`` that the ledger has, one row each.

        Each content of ``rows`` is asked for once, however many rows have it.
        """
        asked = self.maybe_known(rows.select("hash").distinct())
        listed = [row["hash"] for row in asked.limit(few + 1).collect()]
        ledger = self.rows()
        if len(listed) <= few:
            found = ledger.where(F.col("hash").isin(listed)) if listed else ledger.limit(0)
        else:
            found = ledger.join(asked, "hash", "left_semi")
        return found.groupBy("hash").agg(F.min("dest_path").alias("dest_path"))


def create_bucketed(spark: SparkSession, folder: str, buckets: int, expected_rows: int) -> BucketedLedger:
    """Lay out an empty bucketed ledger.

    ``buckets`` should be no fewer than the shuffle partitions of the runs that join it,
    or Spark prefers to move both sides; ``expected_rows`` sizes the filter.
    """
    if open_bucketed(spark, folder):
        raise ValueError(f"{folder} holds a bucketed ledger already")
    if _children(spark, folder):
        raise ValueError(f"{folder} is not empty")
    ledger = BucketedLedger(spark, folder, buckets, max(1, ceil(expected_rows / buckets / ROWS_PER_BLOCK)))
    ledger.append(spark.createDataFrame([], schemas.LEDGER))
    return ledger


def open_bucketed(spark: SparkSession, folder: str) -> BucketedLedger | None:
    """The bucketed ledger of a folder, or None where it holds another or none."""
    for name in _children(spark, folder):
        if match := _FOLDER.match(name):
            return BucketedLedger(spark, folder, int(match[1]), int(match[2]))
    return None
