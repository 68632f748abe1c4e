"""A whole run: estimate, classify, place, write, record, account."""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold import schemas
from tidefold.functions import states
from tidefold.operators import accounting, classify, recovery, report, snapshots
from tidefold.operators.dating import best_date, effective_date
from tidefold.operators.lookups import with_dest_taken
from tidefold.operators.placement import final_results
from tidefold.operators.skew import HOT_ROWS, measure_hot_keys
from tidefold.session import Scratch
from tidefold.sources import ledger as ledgers
from tidefold.sources import listing as listings
from tidefold.sources import sinks
from tidefold.sources.buckets import open_bucketed
from tidefold.sources.journal import (
    DUE_ROW,
    LANDED_ROW,
    PLANNED,
    PLANNED_ROW,
    RECORDED,
    WRITTEN,
    Journal,
    read_or_empty,
)


@dataclass
class Inputs:
    """What a run works on.

    An inventory without a ``hash`` column is one of files on a shared mount:
    they are hashed where it matters, and their content is what gets written.
    With hashes, ``payload`` (``path`` and any columns) is written instead. Paths in
    ``due`` (the journal's) are looked at whatever their age. ``ledger_stays`` tells that
    the ledger is bucketed by hash and is joined where it lies. With a ``snapshot`` of the
    last listing, files it tells to be the same, at their path or moved, are not hashed
    again: same name, size and time are taken for the same content.
    """

    inventory: DataFrame
    tags: DataFrame
    listing: DataFrame
    ledger: DataFrame
    scan_errors: DataFrame
    payload: DataFrame | None = None
    due: DataFrame | None = None
    ledger_stays: bool = False
    snapshot: DataFrame | None = None


@dataclass
class Target:
    """Where a run writes, and how destinations and report paths are named.

    Payload goes to a folder per run below ``payload_table``, which reads as one table.
    The journal lies beside the ledger unless it is named; with ``keep_snapshots`` each run
    leaves its listing there for the next.
    Below ``report_folder`` each run leaves a folder of its own, named by its time,
    with ``rows``, ``summary``, ``badges``, ``recency``, ``reconciliation``,
    ``errors``, ``by_state`` and ``months``.
    """

    dest_folder: str
    payload_table: str
    ledger_table: str
    report_folder: str
    source_folder: str = ""
    journal_folder: str = ""
    keep_snapshots: bool = False

    def journal(self, spark: SparkSession) -> Journal:
        return Journal(spark, self.journal_folder or f"{self.ledger_table.rstrip('/')}-journal")

    def payload_of(self, run: str) -> str:
        return f"{self.payload_table.rstrip('/')}/run={run}"


class UnfinishedRun(RuntimeError):
    """An earlier run died; ``recover_runs`` completes it."""


@dataclass
class Outcome:
    """One-row estimate; results and summary unless space was short."""

    gate: DataFrame
    results: DataFrame | None = None
    summary: DataFrame | None = None


def classify_run(
    inputs: Inputs,
    mark: Column,
    dest_folder: str,
    scratch: Scratch,
    hot_rows: int = HOT_ROWS,
    digest: str = "md5",
) -> DataFrame:
    """Final results of a run, in stages cut where a measure pays.

    Dates and destinations are written once; their size and hot keys decide how
    the lookups are split. Files are hashed only after every test that needs no
    content, each file once.
    """
    rejected, passed = classify.split_early(inputs.inventory, mark, inputs.due)
    dated = effective_date(best_date(passed, inputs.tags))
    keyed, seen = scratch.save_measured(
        classify.with_destination(dated, dest_folder), "keyed", F.count(F.lit(1)).alias("rows")
    )
    hot_dest = measure_hot_keys(keyed, "dest_path", seen["rows"], hot_rows)
    looked_up = with_dest_taken(keyed, inputs.listing, hot_dest)
    if "hash" not in inputs.inventory.columns:
        looked_up = scratch.save(looked_up, "looked-up")
        still_open = F.col("dest_path").isNotNull() & ~F.col("dest_taken")
        nothing = F.lit(None).cast("string")
        closed = looked_up.where(~still_open).withColumns({"hash": nothing, "read_error": nothing})
        opened = looked_up.where(still_open)
        if inputs.snapshot is not None:
            known = snapshots.with_carried_hash(inputs.inventory.select("path", "size", "mtime"), inputs.snapshot)
            known = scratch.save(known.where(F.col("hash").isNotNull()).select("path", "hash"), "carried")
            carried = opened.join(known, "path").withColumn("read_error", nothing)
            closed = closed.unionByName(carried)
            opened = opened.join(known, "path", "left_anti")
        hashed = listings.hash_files(opened, digest)
        looked_up = scratch.save(hashed.unionByName(closed), "hashed")
    hot_hash = measure_hot_keys(
        looked_up if "hash" not in keyed.columns else keyed, "hash", seen["rows"], hot_rows
    )
    if inputs.payload is not None:
        looked_up = classify.with_payload_known(looked_up, inputs.payload)
    settled = classify.with_states(looked_up, inputs.ledger, hot_hash, inputs.ledger_stays)
    # Candidates are some of these rows, so no key of theirs is hotter.
    hot = (hot_dest, hot_hash)
    return final_results(classify.with_rejected(settled, rejected), scratch, hot_rows, hot)


def with_copy_errors(results: DataFrame, failed: DataFrame, digest: str = "md5") -> DataFrame:
    """Results in which the ``failed`` ones of the copied rows are copy errors.

    So are the rows of the run that gave way to them, as duplicates or for their
    destination: nothing holds their content either. The failed files are read
    once more for the reason, as the write tells only which are missing.
    """
    named = {"path": "_holder", "hash": "_planned", "dest_path": "_held"}
    seen = listings.hash_files(failed.withColumnsRenamed(named).withColumn("path", F.col("_holder")), digest)
    changed = F.when(F.col("hash") != F.col("_planned"), "content changed since it was hashed")
    reason = F.coalesce("read_error", changed, F.lit("could not be read while it was copied"))
    reasons = seen.select("_holder", "_held", reason.alias("_reason"))
    counts_on = F.when(
        F.col("state").isin(states.COPIED, states.DUPLICATE, states.SKIPPED_DEST_EXISTS),
        F.coalesce("existing_path", "dest_path"),
    )
    # Rows without such a key get one of their own; null keys would meet in one task.
    keyed = results.withColumn("_held", F.coalesce(counts_on, F.concat(F.lit("none:"), "path")))
    missed = F.col("_holder").isNotNull()
    own = F.col("_holder") == F.col("path")
    message = F.when(own, F.col("_reason")).otherwise(
        F.concat(F.lit("gave way to a file that was not copied: "), "_holder")
    )
    return keyed.join(reasons, "_held", "left").withColumns({
        "state": F.when(missed, states.ERROR_COPY).otherwise(F.col("state")),
        "existing_path": F.when(~missed, F.col("existing_path")),
        "error": F.when(missed, message).otherwise(F.col("error")),
        "bytes_copied": F.when(missed, 0).otherwise(F.col("bytes_copied")).cast("bigint"),
    }).select(*results.columns)


def estimate_run(
    inputs: Inputs, mark: Column, dest_folder: str, available_bytes: int
) -> DataFrame:
    """The space check made before anything is hashed or written."""
    totals = classify.plan_totals(inputs.inventory, inputs.listing, mark, dest_folder, inputs.due)
    return accounting.capacity_gate(totals, available_bytes)


def recover_runs(spark: SparkSession, target: Target, scratch: Scratch | None = None) -> list[str]:
    """Complete the runs that died, in order; their names.

    What such a run planned is joined with what landed of it: landed rows that the
    ledger lacks are recorded, the others are due again. Reads the tables of these runs
    and the ledger's hashes. Dying here as well leaves the run as unfinished as it was.
    """
    journal, scratch = target.journal(spark), scratch or Scratch(spark)
    died = journal.unfinished()
    for run, state, as_of in died:
        if state == PLANNED:
            payload = read_or_empty(spark, target.payload_of(run), None)
            # Columns of a payload table may have any name; these together are those of files.
            in_parts = {"part", "parts", "content"} <= set(payload.columns)
            journal.write("landed", run, recovery.landed_keys(payload, in_parts))
            journal.mark(run, WRITTEN, as_of)
        judged = scratch.save(
            recovery.judge_planned(
                journal.read("planned", run, PLANNED_ROW),
                journal.read("landed", run, LANDED_ROW),
                ledgers.open_ledger(spark, target.ledger_table),
            ),
            f"recovered-{run}",
        )
        rows = judged.where(F.col("action") == recovery.RECORD)
        ledgers.add_rows(rows.withColumn("mtime", F.unix_seconds("mtime")).withColumnRenamed("path", "src_path"), target.ledger_table)
        due = journal.read("due", run, DUE_ROW).unionByName(recovery.due_from_planned(judged))
        journal.write("due", run, scratch.save(due.dropDuplicates(["path", "kind"]), f"due-{run}"))
        journal.mark(run, RECORDED, as_of)
    return [run for run, _, _ in died]


def scan_inputs(
    spark: SparkSession, source: str, target: Target, scratch: Scratch, tags: DataFrame | None = None
) -> Inputs:
    """Inputs of a run over files, once the runs that died are completed."""
    recover_runs(spark, target, scratch)
    inventory, scan_errors = listings.walk_tree(spark, source, scratch)
    journal = target.journal(spark)
    return Inputs(
        inventory,
        tags if tags is not None else spark.createDataFrame([], schemas.TAGS),
        journal.taken(),
        ledgers.open_ledger(spark, target.ledger_table),
        scan_errors,
        due=journal.due(),
        ledger_stays=open_bucketed(spark, target.ledger_table) is not None,
        snapshot=journal.last("snapshot", snapshots.SNAPSHOT) if target.keep_snapshots else None,
    )


def run_ingest(
    spark: SparkSession,
    inputs: Inputs,
    target: Target,
    as_of: datetime,
    available_bytes: int,
    incremental: bool = True,
    scratch: Scratch | None = None,
    digest: str = "md5",
) -> Outcome:
    """One run: planned in the journal, written, recorded. All runs on one ledger need
    the same digest; inputs are read after ``recover_runs``."""
    begin = time.monotonic()
    scratch, journal = scratch or Scratch(spark), target.journal(spark)
    if died := journal.unfinished():
        raise UnfinishedRun(f"recover_runs has to complete {', '.join(run for run, _, _ in died)}")
    mark = ledgers.watermark_seconds(inputs.ledger, incremental)
    gate = scratch.save(
        estimate_run(inputs, mark, target.dest_folder, available_bytes), "gate"
    )
    if not gate.first()["sufficient"]:
        return Outcome(gate)

    classified = classify_run(inputs, mark, target.dest_folder, scratch, digest=digest)
    results = scratch.save(classified, "results")
    due = inputs.due if inputs.due is not None else spark.createDataFrame([], DUE_ROW)

    run = journal.new_run(as_of)
    accepted = sinks.accepted(results)
    journal.write("planned", run, accepted.withColumn("copied_at", F.date_trunc("second", F.lit(as_of))))
    journal.write("due", run, recovery.due_again(results, inputs.scan_errors, due))
    if target.keep_snapshots:
        journal.write("snapshot", run, listed_now(results, inputs.snapshot))
    journal.mark(run, PLANNED, as_of)

    folder = target.payload_of(run)
    if inputs.payload is None:
        failed = scratch.save(sinks.write_files_by_month(results, folder, digest), "failed")
        if not failed.isEmpty():
            results = scratch.save(with_copy_errors(results, failed, digest), "settled")
            journal.write("due", run, recovery.due_again(results, inputs.scan_errors, due))
    else:
        sinks.write_months(sinks.accepted_payload(results, inputs.payload), folder)
    journal.write("landed", run, sinks.accepted(results).select("dest_path"))
    journal.mark(run, WRITTEN, as_of)

    # Summary and report describe the run as it was before its own append.
    summary = scratch.save(accounting.accounting_summary(results, inputs.scan_errors), "summary")
    seconds = time.monotonic() - begin
    write_run_report(inputs, target, results, summary, as_of, incremental, seconds)
    ledgers.write_ledger(results, as_of, target.ledger_table)
    journal.mark(run, RECORDED, as_of)
    return Outcome(gate, results, summary)


def listed_now(results: DataFrame, before: DataFrame | None) -> DataFrame:
    """The listing a run leaves: hashes it made or was given, else those that still hold."""
    listed = results.select("path", "size", "mtime", "hash")
    if before is None:
        return listed
    old = before.select("path", F.struct("size", "mtime").alias("_facts"), F.col("hash").alias("_hash"))
    holds = F.col("_facts").eqNullSafe(F.struct("size", "mtime"))
    joined = listed.join(old, "path", "left")
    return joined.select("path", "size", "mtime", F.coalesce("hash", F.when(holds, F.col("_hash"))).alias("hash"))


def write_run_report(
    inputs: Inputs,
    target: Target,
    results: DataFrame,
    summary: DataFrame,
    as_of: datetime,
    incremental: bool,
    seconds: float,
) -> None:
    errors = inputs.scan_errors
    context = accounting.run_context(results, errors, inputs.ledger, incremental, as_of)
    tables = {
        "rows": report.report_rows(results, errors, target.source_folder, target.dest_folder),
        "summary": accounting.outcome_bucket(summary),
        "badges": accounting.report_badges(results, errors, seconds),
        "recency": accounting.recency_bucket(context, as_of),
        "reconciliation": accounting.reconciliation(summary),
        "errors": report.error_rows(results, errors),
        "by_state": accounting.accounting_by_state(results),
        "months": accounting.month_totals(results),
    }
    folder = run_folder(target, as_of)
    for name, table in tables.items():
        sinks.write_report(table, f"{folder}/{name}")


def run_folder(target: Target, as_of: datetime) -> str:
    """Where the report of the run made at ``as_of`` lies."""
    return f"{target.report_folder}/run-{as_of.astimezone(timezone.utc):%Y%m%dT%H%M%S.%fZ}"
