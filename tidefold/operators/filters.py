"""Row filters of a run and of its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions.paths import ALLOWED_EXTENSIONS, extension
from tidefold.sources.ledger import watermark_seconds


def allowed(path: Column) -> Column:
    return extension(path).isin(*ALLOWED_EXTENSIONS)


def allow_listed(inventory: DataFrame) -> DataFrame:
    return inventory.where(allowed(F.col("path")))


def newer_than(mtime: Column, mark: Column) -> Column:
    """Strictly newer in whole seconds; a row without mtime is not held back."""
    return F.coalesce(F.unix_seconds(mtime) > mark, F.lit(True))


def incremental_filter(
    inventory: DataFrame, ledger: DataFrame, incremental: bool = True
) -> DataFrame:
    """Rows changed since the last run. The watermark is a scalar subquery: one
    value, computed once, not a join."""
    return inventory.where(newer_than(F.col("mtime"), watermark_seconds(ledger, incremental)))


def valid_date_filter(dated: DataFrame) -> DataFrame:
    return dated.where(F.col("date_wall").isNotNull())


def report_filter(report: DataFrame, status: str = "all", term: str = "") -> DataFrame:
    """Report rows of a status whose path holds a term, whatever the case."""
    rows = report if status == "all" else report.where(F.col("status") == status)
    if term:
        rows = rows.where(F.contains(F.lower("path"), F.lit(term.lower())))
    return rows
