"""Chains of a placement, ranked in parallel.

Where every destination and every content has two rows at most, a row has one neighbour
by each, and rows form paths and rings. A row is copied exactly if none of its earlier
neighbours is. So a row without an earlier neighbour is copied; one with a single earlier
neighbour is copied if that one is not, which makes its fate the parity of its distance
to the row where the falling path ends; one between two earlier neighbours waits for
both, and nothing waits for it. Distances are found by pointer jumping: each round a row
that has not reached its end takes over where its pointer points to, so a path of n rows
takes log2 n rounds, and no task holds a path.

In a round the open rows are joined to the rows they point to. An open row is pointed to
by one open row at most, so no key of these joins is hot, and rows that have reached
their end take part as targets alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.session import Scratch


def _earlier_in(edges: DataFrame, key: str, name: str) -> DataFrame:
    """The later row of each pair at ``key``, and its earlier neighbour."""
    pairs = edges.groupBy(key).agg(F.min("place").alias(name), F.max("place").alias("place"))
    return pairs.where(F.col(name) < F.col("place")).select("place", name)


def with_earlier(edges: DataFrame) -> DataFrame:
    """Add ``by_dest`` and ``by_hash``: the places of the earlier neighbours, or null.

    For edges of which no destination and no content has more than two rows.
    """
    by_dest = _earlier_in(edges, "dest_path", "by_dest")
    by_hash = _earlier_in(edges, "hash", "by_hash")
    return edges.join(by_dest, "place", "left").join(by_hash, "place", "left")


def falling_distance(pointers: DataFrame, ends: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``place, steps``: how many pointers lie between each place and the end of its path.

    ``pointers`` (place, towards) are falling; ``ends`` (place) are where they may end.
    """
    done = ends.select("place", F.lit(None).cast("bigint").alias("towards"), F.lit(0).cast("bigint").alias("steps"))
    still = scratch.save(pointers.select("place", "towards", F.lit(1).cast("bigint").alias("steps")), f"{name}-0")
    finished, turn = [done], 0
    while True:
        turn += 1
        targets = still
        for part in finished:
            targets = targets.unionByName(part)
        jump = targets.select(
            F.col("place").alias("towards"), F.col("towards").alias("_further"), F.col("steps").alias("_more")
        )
        moved, seen = scratch.save_measured(
            still.join(jump, "towards").select(
                "place", F.col("_further").alias("towards"), (F.col("steps") + F.col("_more")).alias("steps")
            ),
            f"{name}-{turn}",
            F.count("towards").alias("open"),
        )
        finished.append(moved.where(F.col("towards").isNull()))
        if not seen["open"]:
            break
        still = moved.where(F.col("towards").isNotNull())
    settled = finished[0]
    for part in finished[1:]:
        settled = settled.unionByName(part)
    return settled.select("place", "steps")


def place_chains(edges: DataFrame, scratch: Scratch, name: str = "chains") -> DataFrame:
    """The copied ones of ``edges`` (place, dest_path, hash), pairs at most at each key."""
    linked = scratch.save(with_earlier(edges), f"{name}-linked")
    first = F.coalesce("by_dest", "by_hash")
    # Two rows that share both keys are one neighbour.
    both = F.col("by_dest").isNotNull() & F.col("by_hash").isNotNull() & (F.col("by_dest") != F.col("by_hash"))
    ends = linked.where(first.isNull()).select("place")
    pointers = linked.where(first.isNotNull() & ~both).select("place", first.alias("towards"))
    steps = falling_distance(pointers, ends, scratch, f"{name}-steps")
    copied = scratch.save(steps.where(F.col("steps") % 2 == 0).select("place"), f"{name}-even")
    won_dest = copied.select(F.col("place").alias("by_dest"), F.lit(True).alias("_dest_won"))
    won_hash = copied.select(F.col("place").alias("by_hash"), F.lit(True).alias("_hash_won"))
    between = linked.where(both).join(won_dest, "by_dest", "left").join(won_hash, "by_hash", "left")
    free = between.where(F.col("_dest_won").isNull() & F.col("_hash_won").isNull()).select("place")
    return edges.join(copied.unionByName(free), "place", "left_semi").select(*edges.columns)
