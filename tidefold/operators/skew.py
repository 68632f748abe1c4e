"""Joins that stay balanced when one key holds a large share of the rows.

The rows of a hot key are spread over several salts, and the few matching rows
of the other side are repeated once per salt. Which keys count as hot changes
the balance, never the result.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Below this many rows a key fits any task.
HOT_ROWS = 200_000


@dataclass(frozen=True)
class HotKeys:
    """Hot values of one column, and over how many salts to spread them."""

    column: str
    values: tuple[str, ...] = ()
    salts: int = 1

    def on(self, column: str) -> HotKeys:
        return HotKeys(column, self.values, self.salts)


def measure_hot_keys(
    df: DataFrame, column: str, rows: int | None = None, hot_rows: int = HOT_ROWS
) -> HotKeys:
    """Keys that outweigh an average shuffle partition.

    Counted exactly, combined before the shuffle. There are at most as many such
    keys as shuffle partitions, which bounds what reaches the driver; a table
    too small to hold any is not read.
    """
    rows = df.count() if rows is None else rows
    if rows <= hot_rows:
        return HotKeys(column)
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = max(hot_rows, ceil(rows / width))
    hot = (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > limit)
        .collect()
    )
    if not hot:
        return HotKeys(column)
    heaviest = max(row["rows"] for row in hot)
    salts = max(2, min(width, ceil(heaviest / limit)))
    return HotKeys(column, tuple(sorted(row[column] for row in hot)), salts)


def balanced_join(
    left: DataFrame, right: DataFrame, how: str, hot: HotKeys, spread_by: str
) -> DataFrame:
    """``left`` joined on ``hot.column``, its hot keys split by ``spread_by``.

    For left-preserving and inner joins: each left row still meets every right
    row of its key exactly once.
    """
    key = hot.column
    if not hot.values:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(*hot.values), F.lit(False))
    salt = F.pmod(F.xxhash64(spread_by), F.lit(hot.salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(hot.salts - 1))
    salted = left.withColumn("_salt", F.when(is_hot, salt).otherwise(0))
    repeated = right.withColumn(
        "_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0))))
    )
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def stay_join(left: DataFrame, right: DataFrame, how: str, hot: HotKeys) -> DataFrame:
    """``left`` joined on ``hot.column`` to a ``right`` that is bucketed by it and stays in place.

    A salt would move ``right``. So the rows of the hot keys are joined apart, to the rows
    of ``right`` that have these keys: at most as many as there are hot keys, since ``right``
    has one row per key, hence few enough to be broadcast. For joins that keep or drop left
    rows one by one (left, inner, semi, anti).
    """
    key = hot.column
    if not hot.values:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(*hot.values), F.lit(False))
    few = F.broadcast(right.where(F.col(key).isin(*hot.values)))
    return left.where(~is_hot).join(right, key, how).unionByName(left.where(is_hot).join(few, key, how))
