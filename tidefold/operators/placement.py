"""Placing the candidates of one run among each other.

In walk order a candidate is copied unless an earlier copied row took its
destination or holds its content. Seen as a graph each candidate is an edge
between a destination and a content, and the copied rows are the matching a
greedy pass in walk order would choose. It is found in rounds: every row that
comes first both at its destination and for its content is certainly copied,
and whatever shares one of the two with it certainly is not (Blelloch, Fineman,
Shun: Greedy Sequential Maximal Independent Set and Matching are Parallel on
Average, SPAA 2012).
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.functions import states
from tidefold.functions.paths import walk_key
from tidefold.operators.chains import place_chains
from tidefold.operators.classify import RESULT_COLUMNS
from tidefold.operators.components import components
from tidefold.operators.skew import HOT_ROWS, HotKeys, balanced_join, measure_hot_keys
from tidefold.session import Scratch

log = logging.getLogger(__name__)

# After this many rounds what is left is chains, which a round shortens by one
# step only. They are then settled by connected component.
PATIENCE = 8


def number_in_walk_order(rows: DataFrame) -> DataFrame:
    """Add ``place``, increasing in walk order.

    A range partitioning sorted within its partitions: no global window, and the
    later rounds compare a BIGINT, which aggregates in place, not a path.
    """
    return (
        rows.withColumn("_key", walk_key(F.col("path")))
        .repartitionByRange("_key")
        .sortWithinPartitions("_key")
        .withColumn("place", F.monotonically_increasing_id())
        .drop("_key")
    )


def _first_per(edges: DataFrame, key: str) -> DataFrame:
    return edges.groupBy(key).agg(F.min("place").alias("place"))


def _certain(edges: DataFrame) -> DataFrame:
    """Rows that come first both at their destination and for their content."""
    return _first_per(edges, "dest_path").join(_first_per(edges, "hash"), "place")


def _settle_rest(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows of a remainder that get copied, component by component.

    Rows that share no destination and no content, not even by others between
    them, cannot bear on each other. Nodes are hashes of the two: should two
    meet, components are settled together, with the same outcome. The number of
    rounds grows with the logarithm of the rows. Components that are mere chains
    are ranked in parallel (``chains``); each other one is walked by a task.
    """
    nodes = edges.withColumns({
        "node": F.xxhash64(F.lit("d"), "dest_path"), "other": F.xxhash64(F.lit("h"), "hash"),
    })
    parts = components(nodes.select("node", "other").toDF("src", "dst"), scratch)
    inside = scratch.save(nodes.join(parts, "node").drop("node", "other"), "rest")
    knots = scratch.save(
        _crowded(inside, "dest_path").unionByName(_crowded(inside, "hash")).distinct(), "knots"
    )
    chains = inside.join(knots, "component", "left_anti").select(*edges.columns)
    knotted = inside.join(knots, "component", "left_semi")
    return place_chains(chains, scratch).unionByName(_walk(knotted, edges))


def _crowded(inside: DataFrame, key: str) -> DataFrame:
    """Components in which some destination, or some content, has more than two rows."""
    sizes = inside.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.first("component").alias("component"))
    return sizes.where(F.col("rows") > 2).select("component")


def _walk(inside: DataFrame, edges: DataFrame) -> DataFrame:
    """The copied rows, each component walked in order by one task."""
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = inside.repartition(width, "component").sortWithinPartitions("component", "place")

    columns, schema = edges.columns, edges.schema

    def walk(batches):
        part, dests, hashes = None, set(), set()
        for batch in batches:
            won = []
            for own, dest, digest in zip(batch["component"], batch["dest_path"], batch["hash"]):
                if own != part:
                    part, dests, hashes = own, set(), set()
                won.append(dest not in dests and digest not in hashes)
                if won[-1]:
                    dests.add(dest)
                    hashes.add(digest)
            yield batch.loc[won, columns]

    return in_order.mapInPandas(walk, schema)


def greedy_placement(
    candidates: DataFrame,
    scratch: Scratch,
    hot_rows: int = HOT_ROWS,
    patience: int = PATIENCE,
    hot: tuple[HotKeys, HotKeys] | None = None,
) -> DataFrame:
    """Candidates (``path, dest_path, hash, ...``) with ``state`` and
    ``existing_path`` settled; all other columns are kept.

    Per round: two combined aggregations, one join of their results on the row
    number, and two anti joins split on hot keys. Each round is written to the
    shared folder, so a lost executor never replays earlier rounds. Rounds are
    few unless rows form long chains; what ``patience`` rounds leave is settled by
    component. ``hot`` are the hot destinations and contents where measured.

    A row without a destination is skipped for want of a date, one without a
    hash is a hash error; neither bears on others.
    """
    whole = F.col("dest_path").isNotNull() & F.col("hash").isNotNull()
    unplaced = candidates.where(~whole).withColumns({
        "state": F.when(F.col("dest_path").isNull(), states.SKIPPED_NO_DATE).otherwise(states.ERROR_HASH),
        "existing_path": F.lit(None).cast("string"),
    })
    placed = _placed(candidates.where(whole), scratch, hot_rows, patience, hot)
    return placed.unionByName(unplaced)


def _placed(
    candidates: DataFrame,
    scratch: Scratch,
    hot_rows: int,
    patience: int,
    hot: tuple[HotKeys, HotKeys] | None,
) -> DataFrame:
    numbered, seen = scratch.save_measured(
        number_in_walk_order(candidates.drop("state", "existing_path")),
        "numbered",
        F.count(F.lit(1)).alias("rows"),
    )
    hot_dest, hot_hash = hot or (
        measure_hot_keys(numbered, column, seen["rows"], hot_rows) for column in ("dest_path", "hash")
    )

    accepted = None
    edges = numbered.select("place", "dest_path", "hash")
    left, rounds = seen["rows"], 0
    while left:
        rounds += 1
        last = rounds > patience
        won = scratch.save(_settle_rest(edges, scratch) if last else _certain(edges), f"won-{rounds}")
        accepted = won if accepted is None else accepted.unionByName(won)
        if last:
            break
        open_dest = balanced_join(edges, won.select("dest_path"), "left_anti", hot_dest, "place")
        still_open = balanced_join(open_dest, won.select("hash"), "left_anti", hot_hash, "place")
        edges, seen = scratch.save_measured(
            still_open, f"open-{rounds}", F.count(F.lit(1)).alias("rows")
        )
        left = seen["rows"]
        log.info("placement round %d leaves %d rows", rounds, left)

    if accepted is None:
        return numbered.drop("place").withColumns({
            "state": F.lit(states.COPIED),
            "existing_path": F.lit(None).cast("string"),
        })
    return _label(numbered, accepted, hot_dest, hot_hash)


def _label(
    numbered: DataFrame, accepted: DataFrame, hot_dest: HotKeys, hot_hash: HotKeys
) -> DataFrame:
    at_dest = accepted.select("dest_path", F.col("place").alias("_dest_place"))
    same_content = accepted.select(
        "hash", F.col("place").alias("_hash_place"), F.col("dest_path").alias("_copy")
    )
    rows = balanced_join(numbered, at_dest, "left", hot_dest, "place")
    rows = balanced_join(rows, same_content, "left", hot_hash, "place")
    place = F.col("place")
    return (
        rows.withColumn(
            "state",
            # The row copied for a content keeps its place; all others of it
            # come later, and lost to their destination or to that copy.
            F.when(F.col("_hash_place") == place, states.COPIED)
            .when(F.col("_dest_place") < place, states.SKIPPED_DEST_EXISTS)
            .when(F.col("_hash_place") < place, states.DUPLICATE),
        )
        .withColumn("existing_path", F.when(F.col("state") == states.DUPLICATE, F.col("_copy")))
        .drop("place", "_dest_place", "_hash_place", "_copy")
    )


def final_results(
    static: DataFrame,
    scratch: Scratch,
    hot_rows: int = HOT_ROWS,
    hot: tuple[HotKeys, HotKeys] | None = None,
) -> DataFrame:
    """One row per file: rows settled against earlier runs, and the candidates
    placed. The static states are read twice, so they are written once."""
    static = scratch.save(static, "static")
    is_candidate = F.col("state") == states.CANDIDATE
    placed = greedy_placement(static.where(is_candidate), scratch, hot_rows, hot=hot)
    every = static.where(~is_candidate).unionByName(placed.select(*RESULT_COLUMNS))
    copied = F.col("state") == states.COPIED
    return every.withColumn("bytes_copied", F.when(copied, F.col("size")).otherwise(0).cast("bigint"))
