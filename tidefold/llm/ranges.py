"""Shards of rows by ranges of an integer key, the same in every run.

Bounds come from ids whose hash falls below a limit, so they depend on the ids
alone. At most about ``PER_SHARD`` ids per shard reach the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PER_SHARD = 32
_PARTS = 1 << 30


def shard_bounds(df: DataFrame, key: str, shards: int) -> list[int]:
    """Ascending ids that cut the rows into ``shards`` of about equal counts."""
    ids = df.where(F.col(key).isNotNull()).select(key)
    rows = ids.count()
    below = min(_PARTS, max(1, shards * PER_SHARD * _PARTS // max(rows, 1)))
    chosen = ids.where(F.pmod(F.xxhash64(key), F.lit(_PARTS)) < below)
    # Repeated ids count once, or one of them could fill the sample.
    sample = sorted(row[0] for row in chosen.distinct().collect())
    return [sample[i * len(sample) // shards] for i in range(1, shards)] if sample else []


def shard_of(key: str, bounds: list[int], descending: bool = False) -> Column:
    """The shard of each row; null ids sort first, or last where descending."""
    cuts = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series, known: pd.Series) -> pd.Series:
        at = np.searchsorted(cuts, ids.to_numpy(np.int64), side="right")
        at = np.where(known.to_numpy(bool), at, 0)
        return pd.Series(len(cuts) - at if descending else at)

    return place(F.coalesce(F.col(key).cast("long"), F.lit(0)), F.col(key).isNotNull())
