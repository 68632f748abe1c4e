"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.session import Scratch

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_of(df: DataFrame) -> Scratch:
    return Scratch(df.sparkSession)


def ascii_lower(text: Column) -> Column:
    """A-Z alone in lower case; other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_batches(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most ``most_bytes``, a single larger row alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most_bytes / max(batch.nbytes, 1)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


class HashFilter:
    """64-bit hashes as two bits each in a bitmap of fixed size, to skip what matches none.

    Its size does not depend on the keys: with very many of them it skips little,
    and what it lets through is compared exactly in any case.
    """

    def __init__(self, keys: DataFrame, bits: int = 1 << 24):
        """From a BIGINT column ``key`` of hashes; one row per 64 bits at most reaches the driver."""
        self.width = bits.bit_length() - 1
        places = [F.shiftrightunsigned("key", 64 - self.width), F.expr(f"key & {bits - 1}L")]
        words = (
            keys.select(F.explode(F.array(*places)).alias("place"))
            .groupBy(F.expr("place div 64").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(place % 64 as int))")).alias("bits"))
            .toArrow()
        )
        self.words = np.zeros(bits // 64, np.int64)
        self.words[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        self.words = self.words.view(np.uint8)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Which of the unsigned hashes may be among the keys."""
        hit = np.arange(len(keys))
        low = np.uint64((1 << self.width) - 1)
        # The second bit is only looked up where the first is set.
        for at in (keys >> np.uint64(64 - self.width), keys & low):
            at = at[hit]
            hit = hit[(self.words[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)]
        found = np.zeros(len(keys), bool)
        found[hit] = True
        return found
