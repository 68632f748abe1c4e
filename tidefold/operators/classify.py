"""What happens to each row, judged by what earlier runs left behind.

Rows the cheap tests reject never enter a join: they are a projection of their
own, and only the others are dated, looked up and hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.functions import states
from tidefold.functions.dates import ZERO_DATE, month_of, wall_clock
from tidefold.functions.paths import destination
from tidefold.operators.dating import best_date, effective_date
from tidefold.operators.filters import allowed, newer_than
from tidefold.operators.lookups import with_dest_taken, with_known_copy
from tidefold.operators.recovery import with_due
from tidefold.operators.skew import HotKeys

# Reasons of the planning estimate.
REASON_EXTENSION = "Extension not allowed"
REASON_OLDER = "File older than last backup"
REASON_NO_DATE = "No valid filesystem date"
REASON_EXISTS = "File already exists at destination"
REASON_READY = "File ready for backup"

RESULT_COLUMNS = (
    "path", "dest_path", "month", "hash", "size", "mtime", "state", "existing_path", "error",
)

# Error of a row that has no payload.
NO_PAYLOAD = "no payload"


def _planned(inventory: DataFrame, mark: Column, dest_folder: str, due: DataFrame | None = None) -> DataFrame:
    """``path, size, early`` and the destination by mtime month; ``early`` is the
    reason of rows that need no look at the destination."""
    path, mtime = F.col("path"), F.col("mtime")
    inventory, is_due = _marked_due(inventory, due)
    wall = F.when(wall_clock(mtime) != ZERO_DATE, wall_clock(mtime))
    return inventory.select(
        "path",
        "size",
        destination(dest_folder, month_of(wall), path).alias("dest_path"),
        F.when(~allowed(path), REASON_EXTENSION)
        .when(~(newer_than(mtime, mark) | is_due), REASON_OLDER)
        .when(wall.isNull(), REASON_NO_DATE)
        .alias("early"),
    )


def plan_classification(
    inventory: DataFrame,
    listing: DataFrame,
    mark: Column,
    dest_folder: str,
    hot_dest: HotKeys | None = None,
) -> DataFrame:
    """The estimate made before a run: by mtime month, without tags or hashes."""
    judged = _planned(inventory, mark, dest_folder)
    rejected = judged.where("early is not null").select(
        "path", "size", F.col("early").alias("reason")
    )
    looked_up = with_dest_taken(judged.where("early is null"), listing, hot_dest).select(
        "path",
        "size",
        F.when(F.col("dest_taken"), REASON_EXISTS).otherwise(REASON_READY).alias("reason"),
    )
    ready = F.col("reason") == REASON_READY
    return rejected.unionByName(looked_up).select(
        "path",
        ready.alias("should_copy"),
        F.when(ready, F.col("size")).otherwise(0).cast("bigint").alias("planned_size"),
        "reason",
    )


def plan_totals(
    inventory: DataFrame, listing: DataFrame, mark: Column, dest_folder: str, due: DataFrame | None = None
) -> DataFrame:
    """The totals of that estimate alone: one row.

    Rows are summed by destination before they are looked up, so each task sends
    one row per destination however many files share it; rejected rows make up
    one more group.
    """
    judged = _planned(inventory, mark, dest_folder, due)
    open_dest = F.when(F.col("early").isNull(), F.col("dest_path"))
    by_dest = judged.groupBy(open_dest.alias("dest_path")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )
    taken = listing.distinct().withColumn("taken", F.lit(True))
    copies = F.col("dest_path").isNotNull() & F.col("taken").isNull()

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")

    return by_dest.join(taken, "dest_path", "left").agg(
        total(F.col("files")).alias("files_found"),
        total(F.when(copies, F.col("files"))).alias("files_to_copy"),
        total(F.when(copies, F.col("bytes"))).alias("estimated_bytes"),
    )


def _marked_due(inventory: DataFrame, due: DataFrame | None) -> tuple[DataFrame, Column]:
    """The inventory, and whether a row of it is due whatever its age."""
    if due is None or due.isEmpty():
        return inventory, F.lit(False)
    return with_due(inventory, due), F.col("due")


def early_state(path: Column, mtime: Column, mark: Column, due: Column | None = None) -> Column:
    """State by extension and age alone, or null if those let the row pass."""
    passes = newer_than(mtime, mark)
    if due is not None:
        passes = passes | due
    return F.when(~allowed(path), states.SKIPPED_EXTENSION).when(~passes, states.SKIPPED_INCREMENTAL)


def split_early(
    inventory: DataFrame, mark: Column, due: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(rejected, passed)``; the rejected rows carry their state."""
    marked, is_due = _marked_due(inventory, due)
    judged = marked.withColumn("state", early_state(F.col("path"), F.col("mtime"), mark, is_due))
    judged = judged.select(*inventory.columns, "state")
    return judged.where("state is not null"), judged.where("state is null").drop("state")


def with_destination(dated: DataFrame, dest_folder: str) -> DataFrame:
    """Month and destination in place of the date they are made from."""
    month = month_of(F.col("date_wall"))
    return dated.withColumns({
        "month": month,
        "dest_path": destination(dest_folder, month, F.col("path")),
    }).drop("date_wall", "confidence", "source")


def with_payload_known(looked_up: DataFrame, payload: DataFrame) -> DataFrame:
    """Add ``has_payload``: whether the payload table has the row's path."""
    there = payload.select("path").distinct().withColumn("_there", F.lit(True))
    joined = looked_up.join(there, "path", "left")
    return joined.withColumn("has_payload", F.col("_there").isNotNull()).drop("_there")


def with_states(
    looked_up: DataFrame, ledger: DataFrame, hot_hash: HotKeys | None = None, ledger_stays: bool = False
) -> DataFrame:
    """Date, destination, content and ledger tests, in that order.

    Expects ``dest_taken`` and ``hash``; a row whose content could not be read
    has a ``read_error`` or no hash. Only rows still open are looked up.
    """
    if "read_error" not in looked_up.columns:
        looked_up = looked_up.withColumn("read_error", F.lit(None).cast("string"))
    readable = F.col("read_error").isNull() & F.col("hash").isNotNull()
    # Without a date there is no destination.
    before_hash = F.when(F.col("dest_path").isNull(), states.SKIPPED_NO_DATE).when(
        F.col("dest_taken"), states.SKIPPED_DEST_EXISTS
    )
    # What cannot be copied must not hold a destination or a content against others.
    has_payload = F.col("has_payload") if "has_payload" in looked_up.columns else F.lit(True)
    matched = with_known_copy(looked_up, ledger, before_hash.isNull() & readable, hot_hash, ledger_stays)
    state = F.coalesce(
        before_hash,
        F.when(~readable, states.ERROR_HASH),
        F.when(F.col("known_path").isNotNull(), states.DUPLICATE),
        F.when(~has_payload, states.ERROR_COPY),
        F.lit(states.CANDIDATE),
    )
    return matched.withColumn("state", state).withColumns({
        "existing_path": F.when(F.col("state") == states.DUPLICATE, F.col("known_path")),
        "error": F.when(F.col("state") == states.ERROR_HASH, F.col("read_error")).when(
            F.col("state") == states.ERROR_COPY, NO_PAYLOAD
        ),
    })


def with_rejected(settled: DataFrame, rejected: DataFrame) -> DataFrame:
    """Settled rows and the early rejected ones, as ``RESULT_COLUMNS``.

    Rejected rows get no hash, so that content behind it is not read for them.
    """
    unknown = ("dest_path", "month", "hash", "existing_path", "error")
    nothing = {name: F.lit(None).cast("string") for name in unknown}
    early = rejected.withColumns(nothing).select(*RESULT_COLUMNS)
    return settled.select(*RESULT_COLUMNS).unionByName(early)


def static_classification(
    inventory: DataFrame,
    tags: DataFrame,
    listing: DataFrame,
    ledger: DataFrame,
    mark: Column,
    dest_folder: str,
) -> DataFrame:
    """State of each row against earlier runs; what passes is a candidate."""
    rejected, passed = split_early(inventory, mark)
    keyed = with_destination(effective_date(best_date(passed, tags)), dest_folder)
    return with_rejected(with_states(with_dest_taken(keyed, listing), ledger), rejected)
