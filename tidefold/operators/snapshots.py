"""The listing of the last run against that of this one.

Rows are matched by path; what is left on either side is matched by content, so a file that
lies elsewhere now is told from a new one. Where this listing has no hashes yet, a file of
the same name, size and time as exactly one that is gone is taken to be that one; its hash
is carried over, and what copies it verifies it against that hash.

One content may be very many files. So contents are matched by the least path of each, an
aggregation combined before its shuffle, never by pairing files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions.paths import basename
from tidefold.operators.skew import HotKeys, balanced_join

SNAPSHOT = "path string, size bigint, mtime timestamp, hash string"

# Kinds of change.
SAME, CHANGED, ADDED, MOVED, LEFT, GONE = "same", "changed", "added", "moved", "left", "gone"


def _beside(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both listings by path: columns of the earlier one begin with ``old_``."""
    old = before.select("path", *(F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "hash")), F.lit(True).alias("_old"))
    new = after.select("path", "size", "mtime", "hash", F.lit(True).alias("_new"))
    return new.join(old, "path", "full_outer")


def _unchanged() -> Column:
    facts = F.col("size").eqNullSafe(F.col("old_size")) & F.col("mtime").eqNullSafe(F.col("old_mtime"))
    return facts & (F.col("hash").isNull() | F.col("hash").eqNullSafe(F.col("old_hash")))


def difference(before: DataFrame, after: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """``path, change, other_path`` of every path of two listings with hashes, a path once in each.

    ``same`` and ``changed`` are in both. Of those in one only, a content that the other
    side has too was ``moved`` here from ``other_path`` (the least that is gone), or has
    ``left`` for ``other_path`` (the least that came); other paths are ``added`` or
    ``gone``. Rows without a hash match no content.
    """
    both = _beside(before, after)
    change = (
        F.when(F.col("_old").isNull(), ADDED)
        .when(F.col("_new").isNull(), GONE)
        .when(_unchanged(), SAME)
        .otherwise(CHANGED)
    )
    judged = both.select("path", F.coalesce("hash", "old_hash").alias("hash"), change.alias("change"))
    spread = hot or HotKeys("hash")

    def matched(kind: str, other: str, renamed: str) -> DataFrame:
        there = (
            judged.where((F.col("change") == other) & F.col("hash").isNotNull())
            .groupBy("hash")
            .agg(F.min("path").alias("other_path"))
        )
        own = judged.where(F.col("change") == kind)
        # Rows without a hash get a key of their own; null keys would meet in one task.
        own = own.withColumn("hash", F.coalesce("hash", F.concat(F.lit("none:"), "path")))
        found = balanced_join(own, there, "left", spread, "path")
        named = F.when(F.col("other_path").isNotNull(), renamed).otherwise(kind)
        return found.select("path", named.alias("change"), "other_path")

    stayed = judged.where(F.col("change").isin(SAME, CHANGED))
    return (
        stayed.select("path", "change", F.lit(None).cast("string").alias("other_path"))
        .unionByName(matched(ADDED, GONE, MOVED))
        .unionByName(matched(GONE, ADDED, LEFT))
    )


def with_carried_hash(after: DataFrame, before: DataFrame) -> DataFrame:
    """``after`` (path, size, mtime, no hash) with the ``hash`` that need not be made again, or null.

    That of the same path, size and time; else that of the one file that is gone and had
    the same name, size and time.
    """
    facts = after.select("path", "size", "mtime", F.lit(None).cast("string").alias("hash"))
    both = _beside(before, facts)
    stayed = both.where(F.col("_new") & F.col("_old") & _unchanged()).select("path", F.col("old_hash").alias("_stayed"))
    look = lambda path, size, mtime: [basename(path).alias("_name"), size.alias("_size"), mtime.alias("_mtime")]
    gone = (
        both.where(F.col("_new").isNull() & F.col("old_hash").isNotNull())
        .groupBy(*look(F.col("path"), F.col("old_size"), F.col("old_mtime")))
        .agg(F.min("old_hash").alias("_moved"), F.count(F.lit(1)).alias("_files"))
        .where("_files = 1")
        .drop("_files")
    )
    came = both.where(F.col("_old").isNull()).select("path", *look(F.col("path"), F.col("size"), F.col("mtime")))
    moved = came.join(gone, ["_name", "_size", "_mtime"]).select("path", "_moved")
    carried = after.drop("hash").join(stayed, "path", "left").join(moved, "path", "left")
    return carried.withColumn("hash", F.coalesce("_stayed", "_moved")).drop("_stayed", "_moved")
