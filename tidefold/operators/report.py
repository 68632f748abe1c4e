"""The per-row report of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions.paths import relative_path, walk_key
from tidefold.functions.states import error_message, status_of, walk_error_message
from tidefold.functions.text import human_size

# Details of the rows that carry no reason of their own.
DETAIL_COPIED = "Successfully copied"
DETAIL_DUPLICATE = "Duplicate of existing file"

SORT_COLUMNS = ("path", "status", "destination", "size", "details")


def report_rows(
    results: DataFrame, scan_errors: DataFrame, src_root: str, dest_root: str
) -> DataFrame:
    """``path, status, destination, size, size_text, details`` of every row."""
    status = status_of(F.col("state"))
    target: Column = F.when(status == "copied", F.col("dest_path")).when(
        status == "duplicate", F.col("existing_path")
    )
    rows = results.select(
        relative_path(F.col("path"), src_root).alias("path"),
        status.alias("status"),
        F.coalesce(relative_path(target, dest_root), F.lit("")).alias("destination"),
        "size",
        F.when(status == "copied", DETAIL_COPIED)
        .when(status == "duplicate", DETAIL_DUPLICATE)
        .when(status == "skipped", F.col("state"))
        .otherwise(F.coalesce("error", "state"))
        .alias("details"),
    )
    unread = scan_errors.select(
        relative_path(F.col("path"), src_root).alias("path"),
        F.lit("error").alias("status"),
        F.lit("").alias("destination"),
        F.lit(None).cast("bigint").alias("size"),
        F.col("message").alias("details"),
    )
    return rows.unionByName(unread).withColumn("size_text", human_size(F.col("size")))


def report_sort(report: DataFrame, by: str = "path", ascending: bool = True) -> DataFrame:
    """Sorted by one column; sizes by bytes, texts by code point.

    Rows that tie follow the walk. Beside a fixed order this gives the range
    partitioning a key it can split: most rows may share one status or size.
    """
    if by not in SORT_COLUMNS:
        raise ValueError(f"sort by one of {SORT_COLUMNS}")
    key = F.coalesce("size", F.lit(0)) if by == "size" else F.col(by)
    return report.orderBy(key.asc() if ascending else key.desc(), walk_key(F.col("path")))


def error_rows(results: DataFrame, scan_errors: DataFrame) -> DataFrame:
    """``path, message`` of the rows that failed and the paths not scanned."""
    failed = results.where(status_of(F.col("state")) == "error").select(
        "path", error_message(F.col("path"), F.col("error"), F.col("state")).alias("message")
    )
    unread = scan_errors.select(
        "path", walk_error_message(F.col("path"), F.col("message")).alias("message")
    )
    return failed.unionByName(unread)
