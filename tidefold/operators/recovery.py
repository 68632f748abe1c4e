"""What a died run left undone, and which paths a later run must look at again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.sources.journal import FILE, FOLDER
from tidefold.sources.ledger import ledger_hashes

KNOWN, RECORD, RETRY = "known", "record", "retry"

DIED = "its run ended before it was copied"


def landed_keys(payload: DataFrame, in_parts: bool) -> DataFrame:
    """Destinations whose content is all there.

    Content in parts (``part`` of ``parts``) counts once every part is.
    """
    if not in_parts:
        return payload.select("dest_path").distinct()
    found = payload.groupBy("dest_path").agg(
        F.count_distinct("part").alias("found"), F.max("parts").alias("wanted")
    )
    return found.where("found = wanted").select("dest_path")


def judge_planned(planned: DataFrame, landed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Planned rows with ``action``: known to the ledger, to be recorded, or to be tried again.

    Placement has made planned rows unique by content and by destination, so neither
    join has a hot key.
    """
    there = landed.select("dest_path").distinct().withColumn("_landed", F.lit(True))
    known = ledger_hashes(ledger).distinct().withColumn("_known", F.lit(True))
    judged = planned.join(there, "dest_path", "left").join(known, "hash", "left")
    action = (
        F.when(F.col("_known"), KNOWN).when(F.col("_landed"), RECORD).otherwise(RETRY)
    )
    return judged.select(*planned.columns, action.alias("action"))


def failed(state: Column) -> Column:
    return F.startswith(state, F.lit("error"))


def paths_at_or_below(paths: DataFrame, places: DataFrame) -> DataFrame:
    """Distinct ``path`` of ``paths`` that is one of ``places`` or lies below one.

    Each path asks for itself and the folders above it, so this is an equi-join; the
    places that could not be read are few and are left to be broadcast by their size.
    """
    parts = F.split(F.rtrim("path", F.lit("/")), "/")
    above = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    wanted = places.select(F.rtrim("path", F.lit("/")).alias("_above")).distinct()
    asked = paths.select("path", F.explode(above).alias("_above"))
    return asked.join(wanted, "_above").select("path").distinct()


def due_again(results: DataFrame, scan_errors: DataFrame, before: DataFrame) -> DataFrame:
    """``path, kind, reason`` of what a run could not settle.

    Files it failed on, places it could not list, and files due before that lie in such
    a place. Whatever it met and settled, or found gone, is due no longer.
    """
    own = results.where(failed(F.col("state"))).select(
        "path", F.lit(FILE).alias("kind"), F.coalesce("error", "state").alias("reason")
    )
    unlisted = scan_errors.select("path", F.lit(FOLDER).alias("kind"), F.col("message").alias("reason"))
    earlier = before.where(F.col("kind") == FILE)
    hidden = earlier.join(paths_at_or_below(earlier, scan_errors), "path", "left_semi")
    unmet = hidden.join(results.select("path"), "path", "left_anti").select(*own.columns)
    return own.unionByName(unlisted).unionByName(unmet).dropDuplicates(["path", "kind"])


def with_due(inventory: DataFrame, due: DataFrame) -> DataFrame:
    """Add ``due``: whether a path, or a folder above it, is due again."""
    files = due.where(F.col("kind") == FILE).select("path")
    below = paths_at_or_below(inventory, due.where(F.col("kind") == FOLDER))
    hits = files.unionByName(below).distinct().withColumn("_due", F.lit(True))
    matched = inventory.join(hits, "path", "left")
    return matched.select(*inventory.columns, F.coalesce("_due", F.lit(False)).alias("due"))


def due_from_planned(judged: DataFrame) -> DataFrame:
    """Planned rows that did not land, as paths due again."""
    rest = judged.where(F.col("action") == RETRY)
    return rest.select("path", F.lit(FILE).alias("kind"), F.lit(DIED).alias("reason"))
