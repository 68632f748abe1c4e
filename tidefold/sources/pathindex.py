"""An index of a report by the three-letter pieces of its paths.

The report is written in ranges of its paths, so names that have much in common lie in few
files. Beside it lies, for each piece of three characters of a lower-cased path, which files
have it: one row per piece and file. A search asks for the files that have every piece of
its term and reads these alone; the rows are then filtered as in a scan, so the index only
decides what need not be read. A term of fewer than three characters is a scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.operators.filters import report_filter

PIECE = 3


def _pieces(text: str) -> list[str]:
    return sorted({text[i : i + PIECE] for i in range(len(text) - PIECE + 1)})


def write_indexed(report: DataFrame, folder: str, files: int | None = None) -> None:
    """Write report rows in ranges of paths below ``folder``, and their index."""
    spark = report.sparkSession
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    report.repartitionByRange(files, "path").write.mode("overwrite").parquet(f"{folder}/rows")
    rows = spark.read.schema(report.schema).parquet(f"{folder}/rows")
    lower = F.lower("path")
    pieces = F.transform(
        F.sequence(F.lit(1), F.length(lower) - PIECE + 1), lambda at: F.substring(lower, at, F.lit(PIECE))
    )
    # Within a task the pieces of a file are few; they are combined before they move.
    held = rows.select(
        F.explode(F.when(F.length(lower) >= PIECE, F.array_distinct(pieces))).alias("piece"),
        F.col("_metadata.file_name").alias("file"),
    ).distinct()
    held.repartitionByRange(files, "piece").sortWithinPartitions("piece").write.mode("overwrite").parquet(f"{folder}/pieces")


def files_with(spark: SparkSession, folder: str, term: str) -> list[str] | None:
    """Names of the files that may hold the term (one name per file of the report); None for a scan."""
    asked = _pieces(term.lower())
    if not asked:
        return None
    index = spark.read.schema("piece string, file string").parquet(f"{folder}/pieces")
    found = index.where(F.col("piece").isin(asked)).groupBy("file").agg(F.count_distinct("piece").alias("found"))
    return sorted(row["file"] for row in found.where(F.col("found") == len(asked)).collect())


def search(spark: SparkSession, folder: str, status: str = "all", term: str = "") -> DataFrame:
    """``report_filter`` over an indexed report."""
    whole = spark.read.parquet(f"{folder}/rows")
    names = files_with(spark, folder, term)
    if names is None:
        return report_filter(whole, status, term)
    if not names:
        return whole.limit(0)
    read = spark.read.schema(whole.schema).parquet(*(f"{folder}/rows/{name}" for name in names))
    return report_filter(read, status, term)
