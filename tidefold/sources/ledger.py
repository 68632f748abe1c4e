"""The ledger: one row per content ever copied, kept as an append-only table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold import schemas
from tidefold.functions.paths import walk_key
from tidefold.functions.states import COPIED
from tidefold.functions.text import ago_text
from tidefold.sources.buckets import open_bucketed
from tidefold.sources.journal import read_or_empty

MINUS_INFINITY = -(2**62)


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger of a folder, bucketed or plain; empty if nothing was ever written."""
    bucketed = open_bucketed(spark, path)
    return bucketed.rows() if bucketed else read_or_empty(spark, path, schemas.LEDGER)


def ledger_hashes(ledger: DataFrame) -> DataFrame:
    """The contents ever copied, as often as they are recorded: enough for semi and anti joins."""
    return ledger.where(F.col("hash").isNotNull()).select("hash")


def known_hashes(ledger: DataFrame) -> DataFrame:
    """What a duplicate lookup needs: one row per content, with the least of its paths.

    A repeated append may record a content twice; reduced here, on the join's own
    partitioning, it cannot double the rows of a lookup.
    """
    return (
        ledger.where(F.col("hash").isNotNull())
        .groupBy("hash")
        .agg(F.min("dest_path").alias("dest_path"))
    )


def watermark(ledger: DataFrame) -> DataFrame:
    """One row: when the last copy was made, null for an empty ledger."""
    return ledger.agg(F.date_trunc("second", F.max("copied_at")).alias("last_backup"))


def watermark_seconds(ledger: DataFrame, incremental: bool = True) -> Column:
    """The watermark as a scalar for filters; below every date if there is none.

    A watermark at or before 1970 counts as none.
    """
    if not incremental:
        return F.lit(MINUS_INFINITY).cast("bigint")
    seconds = F.unix_seconds("last_backup")
    lowest = F.lit(MINUS_INFINITY).cast("bigint")
    return watermark(ledger).select(F.when(seconds > 0, seconds).otherwise(lowest)).scalar()


def ledger_status(ledger: DataFrame, as_of: datetime) -> DataFrame:
    """One row: last copy, how long ago, and how many contents are known."""
    since = F.unix_seconds(F.lit(as_of)) - F.unix_seconds("last_backup")
    return ledger.agg(
        F.date_trunc("second", F.max("copied_at")).alias("last_backup"),
        F.count_distinct("hash").alias("unique_hashes"),
    ).select(
        F.date_format("last_backup", "yyyy-MM-dd HH:mm:ss").alias("last_backup"),
        ago_text(since).alias("ago"),
        "unique_hashes",
    )


def first_per_hash(rows: DataFrame) -> DataFrame:
    """Of rows with the same content keep the one a walk meets first.

    Combined before the shuffle, so a content copied a million times leaves each
    task as one row.
    """
    others = [name for name in rows.columns if name != "hash"]
    first = F.min_by(F.struct(*others), walk_key(F.col("src_path")))
    return rows.groupBy("hash").agg(first.alias("row")).select("hash", "row.*")


def write_ledger(results: DataFrame, copied_at: datetime, path: str) -> None:
    """Record a run's copied rows, which placement has made unique and new by content."""
    add_rows(ledger_rows(results, copied_at), path)


def add_rows(rows: DataFrame, path: str) -> None:
    """Append rows that are known to be new by content."""
    bucketed = open_bucketed(rows.sparkSession, path)
    if bucketed:
        bucketed.append(rows)
    else:
        rows.select(*schemas.LEDGER.names).write.mode("append").parquet(path)


def ledger_rows(results: DataFrame, copied_at: datetime) -> DataFrame:
    """Ledger rows of the copied results of a run."""
    return results.where(F.col("state") == COPIED).select(
        F.col("path").alias("src_path"),
        "dest_path",
        "hash",
        "size",
        F.unix_seconds("mtime").alias("mtime"),
        F.date_trunc("second", F.lit(copied_at)).alias("copied_at"),
    )


def new_ledger_rows(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """What an append adds: the first row of each content not yet known.

    Reduced first: the lookup then meets each content once, whatever the number
    of its copies, on the partitioning the reduction has made.
    """
    fresh = first_per_hash(rows).join(ledger_hashes(ledger), "hash", "left_anti")
    return fresh.select(*schemas.LEDGER.names)


def append_ledger(rows: DataFrame, ledger: DataFrame, path: str) -> None:
    add_rows(new_ledger_rows(rows, ledger), path)
