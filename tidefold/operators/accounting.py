"""Counts and decisions over the results of a run.

All are aggregations without keys or over a handful of them, combined before
any exchange; the results themselves stay tables and are never collected.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions.paths import walk_key
from tidefold.functions.states import COPIED, status_of
from tidefold.functions.text import DAY, fixed, human_age, human_duration, human_size
from tidefold.operators.skew import HotKeys, balanced_join
from tidefold.sources.ledger import watermark

# Space kept free beyond the estimate, and thresholds of the
# run's description.
SPACE_BUFFER = 100 * 1024 * 1024
GIB = 1024.0**3
FIRST_RUN_SHARE = 0.8
ERROR_SHARE = 0.1
DUPLICATE_SHARE = 0.1
SKIPPED_SHARE = 0.9
RECENT_SECONDS = 30 * DAY


def _rows() -> Column:
    return F.count(F.lit(1))


def _total(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def _status_counts() -> list[Column]:
    status = status_of(F.col("state"))
    return [
        F.count_if(status == "copied").alias("copied"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status == "duplicate").alias("duplicates"),
        F.count_if(status == "error").alias("errors"),
    ]


def plan_estimate(planned: DataFrame) -> DataFrame:
    return planned.agg(
        _rows().alias("files_found"),
        F.count_if("should_copy").alias("files_to_copy"),
        _total(F.when(F.col("should_copy"), F.col("planned_size"))).alias("estimated_bytes"),
    )


def capacity_gate(estimate: DataFrame, available_bytes: int) -> DataFrame:
    """Whether the destination has room for the estimate and the buffer."""
    required = F.col("estimated_bytes") + F.lit(SPACE_BUFFER)
    available = F.lit(available_bytes).cast("bigint")
    return estimate.select(
        "*",
        required.alias("required_bytes"),
        available.alias("available_bytes"),
        fixed(F.col("estimated_bytes") / GIB, 2).alias("estimated_gib"),
        fixed(required / GIB, 2).alias("required_gib"),
        fixed(available / GIB, 2).alias("available_gib"),
        (available >= required).alias("sufficient"),
    )


def accounting_summary(results: DataFrame, scan_errors: DataFrame) -> DataFrame:
    """One row of totals; paths that could not be scanned count as errors."""
    walk_errors = scan_errors.agg(_rows()).scalar()
    return results.agg(
        *_status_counts(),
        _total(F.col("bytes_copied")).alias("total_bytes"),
        _rows().alias("total_files"),
    ).select(
        "copied",
        "skipped",
        "duplicates",
        (F.col("errors") + walk_errors).alias("errors"),
        "total_bytes",
        "total_files",
        walk_errors.alias("walk_errors"),
    )


def accounting_by_state(results: DataFrame) -> DataFrame:
    return results.groupBy("state").agg(
        _rows().alias("files"),
        _total(F.col("size")).alias("bytes"),
        _total(F.col("bytes_copied")).alias("bytes_copied"),
    )


def reconciliation(summary: DataFrame) -> DataFrame:
    """Whether each file, and each path that failed to scan, is accounted for.

    ``files_only`` compares with the files alone and so fails on scan errors.
    """
    accounted = F.col("copied") + F.col("skipped") + F.col("duplicates") + F.col("errors")
    return summary.select(
        accounted.alias("accounted"),
        "total_files",
        "walk_errors",
        (accounted == F.col("total_files") + F.col("walk_errors")).alias("reconciled"),
        (accounted == F.col("total_files")).alias("files_only"),
    )


def oldest_file_age(results: DataFrame, as_of: datetime) -> DataFrame:
    """Age in seconds of the oldest copied file; one day if there is none."""
    age = F.unix_seconds(F.lit(as_of)) - F.unix_seconds("mtime")
    oldest = F.max(F.when((F.col("state") == COPIED) & (age > 0), age))
    seconds = F.coalesce(oldest, F.lit(DAY)).cast("bigint")
    return results.agg(seconds.alias("oldest_seconds")).select(
        "oldest_seconds", human_age(F.col("oldest_seconds")).alias("oldest_age")
    )


def report_badges(
    results: DataFrame, scan_errors: DataFrame, seconds_taken: float
) -> DataFrame:
    walk_errors = scan_errors.agg(_rows()).scalar()
    counted = results.agg(
        _rows().alias("files"),
        _total(F.col("bytes_copied")).alias("data_bytes"),
        *_status_counts(),
    )
    return counted.select(
        (F.col("files") + walk_errors).alias("total_files"),
        "data_bytes",
        human_size(F.col("data_bytes")).alias("data_size"),
        human_duration(F.lit(seconds_taken)).alias("time_taken"),
        "copied",
        "duplicates",
        "skipped",
        (F.col("errors") + walk_errors).alias("errors"),
    )


def run_context(
    results: DataFrame,
    scan_errors: DataFrame,
    ledger: DataFrame,
    incremental: bool,
    as_of: datetime,
) -> DataFrame:
    """One row: last run, age of the oldest copied file, and whether this looks
    like a first run."""
    walk_errors = scan_errors.agg(_rows()).scalar()
    last = watermark(ledger).scalar()
    age = F.unix_seconds(F.lit(as_of)) - F.unix_seconds("mtime")
    copied = F.col("state") == COPIED
    counted = results.agg(
        _rows().alias("files"),
        F.count_if(copied).alias("copied"),
        F.max(F.when(copied & (age > 0), age)).alias("oldest"),
    )
    total = F.col("files") + walk_errors
    mostly_new = F.coalesce(F.try_divide("copied", total) > FIRST_RUN_SHARE, F.lit(False))
    return counted.withColumn("last", last).select(
        F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_backup"),
        (F.lit(not incremental) | F.col("last").isNull() | mostly_new).alias("is_first_run"),
        F.coalesce("oldest", F.lit(DAY)).cast("bigint").alias("oldest_seconds"),
    )


def outcome_bucket(summary: DataFrame) -> DataFrame:
    """The one thing most worth saying about the outcome."""

    def share(column: str) -> Column:
        return F.coalesce(F.try_divide(column, "total_files"), F.lit(0.0))

    return summary.select(
        "*",
        F.when(share("errors") > ERROR_SHARE, "errors")
        .when(F.col("copied") == 0, "nothing")
        .when(share("duplicates") > DUPLICATE_SHARE, "duplicates")
        .when(share("skipped") > SKIPPED_SHARE, "skipped")
        .otherwise("clean")
        .alias("outcome"),
    )


def recency_bucket(context: DataFrame, as_of: datetime) -> DataFrame:
    """Whether the last run is recent, and the span worth mentioning."""
    since = F.unix_seconds(F.lit(as_of)) - F.unix_seconds(F.to_timestamp("last_backup"))
    first = F.col("is_first_run")
    return context.select(
        F.when(first, "first")
        .when(since < RECENT_SECONDS, "recent")
        .otherwise("gap")
        .alias("recency"),
        human_age(F.when(first, F.col("oldest_seconds")).otherwise(since)).alias("span"),
    )


def month_totals(results: DataFrame) -> DataFrame:
    """Files and bytes per destination month of what was copied."""
    return (
        results.where(F.col("state") == COPIED)
        .groupBy("month")
        .agg(_rows().alias("files"), _total(F.col("size")).alias("bytes"))
    )


def content_duplicate_groups(inventory: DataFrame) -> DataFrame:
    """Contents that occur more than once: the first in walk order, and the rest
    in numbers. Combined before the shuffle, so a hot content costs one row per
    task; the copies themselves are never gathered."""
    known = inventory.where("hash is not null")
    # Numbers aggregate in place; the text of a keeper, which does not, is looked for
    # among the contents that do occur more than once.
    repeated = (
        known.groupBy("hash")
        .agg(
            _rows().alias("copies"),
            _total(F.col("size")).alias("_bytes"),
            F.max("size").alias("_size"),
        )
        .where("copies > 1")
    )
    keepers = (
        known.join(repeated.select("hash"), "hash", "left_semi")
        .groupBy("hash")
        .agg(F.min_by("path", walk_key(F.col("path"))).alias("keeper"))
    )
    return (
        repeated.join(keepers, "hash")
        .select(
            "hash",
            "keeper",
            "copies",
            (F.col("copies") - 1).alias("duplicates"),
            (F.col("_bytes") - F.col("_size")).cast("bigint").alias("duplicate_bytes"),
        )
    )


def content_duplicate_pairs(inventory: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Each file that repeats a content, beside the file that a walk meets first:
    ``hash, path, size, keeper``.

    The keeper of a content is one row, joined to its files; the rows of a content that
    very many files have are split where it is known to be hot.
    """
    known = inventory.where("hash is not null").select("hash", "path", "size")
    keepers = known.groupBy("hash").agg(
        F.min_by("path", walk_key(F.col("path"))).alias("keeper"), _rows().alias("copies")
    )
    keepers = keepers.where("copies > 1").select("hash", "keeper")
    return balanced_join(known, keepers, "inner", hot or HotKeys("hash"), "path").where(
        F.col("path") != F.col("keeper")
    ).select("hash", "path", "size", "keeper")
