"""Lookups against what earlier runs left: the ledger and the destination.

Given the measured hot keys of the rows, a lookup splits them; without, that is
left to AQE.

All are equi-joins against a side with unique keys. Whether that side is
broadcast is left to the measured size. Rows that need no lookup get a key of
their own: a null key would send them all to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.operators.skew import HotKeys, balanced_join, stay_join
from tidefold.sources.ledger import known_hashes, ledger_hashes


def _or_unmatched(key: Column) -> Column:
    """The key, or one that nothing matches and that spreads evenly."""
    return F.coalesce(key, F.concat(F.lit("none:"), F.col("path")))


def with_dest_taken(
    rows: DataFrame, listing: DataFrame, hot: HotKeys | None = None
) -> DataFrame:
    """Add ``dest_taken``: whether the destination key exists already."""
    taken = listing.select(F.col("dest_path").alias("_dest"), F.lit(True).alias("_hit"))
    keyed = rows.withColumn("_dest", _or_unmatched(F.col("dest_path")))
    spread = (hot or HotKeys("dest_path")).on("_dest")
    joined = balanced_join(keyed, taken.distinct(), "left", spread, "path")
    return joined.withColumn("dest_taken", F.coalesce("_hit", F.lit(False))).drop("_dest", "_hit")


def with_known_copy(
    rows: DataFrame,
    ledger: DataFrame,
    wanted: Column | None = None,
    hot: HotKeys | None = None,
    stay: bool = False,
) -> DataFrame:
    """Add ``known_path``: where the ledger keeps the same content, or null.

    Rows outside ``wanted`` are not looked up. ``stay``: the ledger is bucketed by hash
    and is not to be moved.
    """
    key = F.col("hash") if wanted is None else F.when(wanted, F.col("hash"))
    known = known_hashes(ledger).select(
        F.col("hash").alias("_hash"), F.col("dest_path").alias("known_path")
    )
    keyed = rows.withColumn("_hash", _or_unmatched(key))
    spread = (hot or HotKeys("hash")).on("_hash")
    joined = stay_join(keyed, known, "left", spread) if stay else balanced_join(keyed, known, "left", spread, "path")
    return joined.drop("_hash")


def ledger_duplicates(
    rows: DataFrame, ledger: DataFrame, hot: HotKeys | None = None, stay: bool = False
) -> DataFrame:
    """Rows whose content the ledger holds, with the path of that copy.

    ``stay``: the ledger is bucketed by hash and is not to be moved.
    """
    hot = hot or HotKeys("hash")
    known = known_hashes(ledger).withColumnRenamed("dest_path", "existing_path")
    return stay_join(rows, known, "inner", hot) if stay else balanced_join(rows, known, "inner", hot, "path")


def dest_exists(rows: DataFrame, listing: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Rows whose destination is taken."""
    hot = hot or HotKeys("dest_path")
    return balanced_join(rows, listing, "left_semi", hot, "path")


def new_content(
    rows: DataFrame,
    ledger: DataFrame,
    listing: DataFrame,
    hot_hash: HotKeys | None = None,
    hot_dest: HotKeys | None = None,
) -> DataFrame:
    """Rows known neither by content nor by destination."""
    hashes = ledger_hashes(ledger)
    fresh = balanced_join(rows, hashes, "left_anti", hot_hash or HotKeys("hash"), "path")
    return balanced_join(fresh, listing, "left_anti", hot_dest or HotKeys("dest_path"), "path")


def insert_or_ignore(
    rows: DataFrame, ledger: DataFrame, hot: HotKeys | None = None, stay: bool = False
) -> DataFrame:
    """Drop rows whose content the ledger already holds (``stay``: without moving it)."""
    hashes = ledger_hashes(ledger)
    if stay:
        return stay_join(rows, hashes.distinct(), "left_anti", hot or HotKeys("hash"))
    return balanced_join(rows, hashes, "left_anti", hot or HotKeys("hash"), "path")
