"""Runs that die, and files that fail once: the next run completes them."""

import hashlib
import os
from datetime import datetime, timezone

import pytest
from helpers import values
from pyspark.sql import functions as F
from test_ingest import FIRST, LATER, by_path, ingest, place, write  # noqa: F401

from tidefold.functions import states
from tidefold.operators import recovery
from tidefold.plans import ingest as plans
from tidefold.plans.ingest import UnfinishedRun, recover_runs, run_ingest, scan_inputs
from tidefold.session import Scratch
from tidefold.sources import journal as journals
from tidefold.sources import ledger as ledgers
from tidefold.sources import sinks


class Killed(Exception):
    pass


def killed(*args, **named):
    raise Killed


def everything_recorded(spark, target):
    """Payload, ledger and journal tell the same."""
    payload = spark.read.parquet(target.payload_table)
    ledger = ledgers.open_ledger(spark, target.ledger_table)
    written = {(r["dest_path"], hashlib.md5(r["content"]).hexdigest()) for r in payload.collect()}
    recorded = values(ledger, "dest_path", "hash")
    assert len(recorded) == len(set(recorded)) and set(recorded) == written
    assert {d for (d,) in values(target.journal(spark).taken(), "dest_path")} == {d for d, _ in written}
    assert target.journal(spark).unfinished() == []
    return {digest for _, digest in written}


def contents(source):
    found = set()
    for folder, _, names in os.walk(source):
        for name in names:
            if not name.endswith(".txt"):
                with open(os.path.join(folder, name), "rb") as file:
                    found.add(hashlib.md5(file.read()).hexdigest())
    return found


@pytest.mark.parametrize("point", ["before payload", "after payload", "before report", "before ledger", "after ledger"])
def test_a_killed_run_is_completed_by_the_next(spark, place, monkeypatch, point):  # noqa: F811
    source, target = place
    os.remove(f"{source}/b/one.jpg")
    with monkeypatch.context() as patch:
        real_files, real_ledger = sinks.write_files_by_month, ledgers.write_ledger
        if point == "before payload":
            patch.setattr(sinks, "write_files_by_month", killed)
        elif point == "after payload":
            patch.setattr(sinks, "write_files_by_month", lambda *a: (real_files(*a), killed()))
        elif point == "before report":
            patch.setattr(plans, "write_run_report", killed)
        elif point == "before ledger":
            patch.setattr(ledgers, "write_ledger", killed)
        else:
            patch.setattr(ledgers, "write_ledger", lambda *a: (real_ledger(*a), killed()))
        with pytest.raises(Killed):
            ingest(spark, source, target, FIRST)
    assert len(target.journal(spark).unfinished()) == 1
    again = by_path(ingest(spark, source, target, LATER), source)
    # Nothing of it has changed since, so only what did not land is copied by an incremental run.
    copied = {path for path, (state, _) in again.items() if state == states.COPIED}
    assert copied == ({".hidden/three.png", "a/one.jpg", "a/two.mp4"} if point == "before payload" else set())
    assert everything_recorded(spark, target) == contents(source)
    assert target.journal(spark).due().count() == 0


def test_a_run_killed_among_its_files(spark, place, monkeypatch):  # noqa: F811
    """Some files land, one lands in part: the next run copies what is missing."""
    source, target = place
    os.remove(f"{source}/b/one.jpg")

    def some(results, folder, digest):
        rows = sinks.accepted(results)
        there = rows.where("path like '%two.mp4'")
        sinks.with_content(there).write.mode("append").partitionBy("month").parquet(folder)
        torn = sinks.with_content(rows.where("path like '%one.jpg'"), part_bytes=2).where("part = 0")
        torn.write.mode("append").partitionBy("month").parquet(folder)
        raise Killed

    with monkeypatch.context() as patch:
        patch.setattr(sinks, "write_files_by_month", some)
        with pytest.raises(Killed):
            ingest(spark, source, target, FIRST)
    again = by_path(ingest(spark, source, target, LATER), source)
    assert {path for path, (state, _) in again.items() if state == states.COPIED} == {".hidden/three.png", "a/one.jpg"}
    hashes = {h for (h,) in values(ledgers.open_ledger(spark, target.ledger_table), "hash")}
    assert hashes == contents(source)


def test_recovery_can_die_and_be_repeated(spark, place, monkeypatch):  # noqa: F811
    source, target = place
    with monkeypatch.context() as patch:
        patch.setattr(ledgers, "write_ledger", killed)
        with pytest.raises(Killed):
            ingest(spark, source, target, FIRST)
    for name in ("judge_planned", "due_from_planned"):
        with monkeypatch.context() as patch:
            patch.setattr(recovery, name, killed)
            with pytest.raises(Killed):
                recover_runs(spark, target)
    assert len(recover_runs(spark, target)) == 1 and recover_runs(spark, target) == []
    everything_recorded(spark, target)


def test_a_run_refuses_to_start_over_a_died_one(spark, place, monkeypatch):  # noqa: F811
    source, target = place
    scratch = Scratch(spark)
    inputs = scan_inputs(spark, source, target, scratch)
    with monkeypatch.context() as patch:
        patch.setattr(ledgers, "write_ledger", killed)
        with pytest.raises(Killed):
            ingest(spark, source, target, FIRST)
    with pytest.raises(UnfinishedRun):
        run_ingest(spark, inputs, target, LATER, 1 << 40, scratch=scratch)


def test_a_file_that_failed_once_is_copied_by_the_next_incremental_run(spark, place):  # noqa: F811
    source, target = place
    os.symlink(f"{source}/later.bin", f"{source}/a/broken.jpg")
    old = datetime(2023, 5, 1, tzinfo=timezone.utc).timestamp()
    os.utime(f"{source}/a/broken.jpg", (old, old), follow_symlinks=False)
    first = by_path(ingest(spark, source, target, FIRST), source)
    assert first["a/broken.jpg"][0] == states.ERROR_HASH
    due = target.journal(spark).due()
    assert values(due, "path", "kind") == [(f"{source}/a/broken.jpg", journals.FILE)]

    second = by_path(ingest(spark, source, target, LATER), source)
    assert second["a/broken.jpg"][0] == states.ERROR_HASH and second["a/one.jpg"][0] == states.SKIPPED_INCREMENTAL

    write(source, "later.bin", b"late")
    third = by_path(ingest(spark, source, target, LATER.replace(day=2)), source)
    assert third["a/broken.jpg"][0] == states.COPIED and third["a/one.jpg"][0] == states.SKIPPED_INCREMENTAL
    assert target.journal(spark).due().count() == 0


def frames(spark, results, errors, before):
    return (
        spark.createDataFrame(results, "path string, state string, error string"),
        spark.createDataFrame(errors, "path string, message string"),
        spark.createDataFrame(before, journals.DUE_ROW),
    )


def test_what_is_due_again(spark):
    results, errors, before = frames(
        spark,
        [("/s/a", states.COPIED, None), ("/s/b", states.ERROR_HASH, "denied"), ("/s/c", states.ERROR_COPY, None)],
        [("/s/closed", "denied"), ("/s/x", "gone")],
        [("/s/a", "file", "r"), ("/s/closed/d/e", "file", "r"), ("/s/vanished", "file", "r"), ("/s/x", "file", "r"),
         ("/s/open", "folder", "r"), ("/s/closed2/f", "file", "r")],
    )
    assert sorted(values(recovery.due_again(results, errors, before), "path", "kind", "reason")) == [
        ("/s/b", "file", "denied"), ("/s/c", "file", states.ERROR_COPY), ("/s/closed", "folder", "denied"),
        ("/s/closed/d/e", "file", "r"), ("/s/x", "file", "r"), ("/s/x", "folder", "gone"),
    ]


def test_paths_below_a_folder_that_could_not_be_listed_are_due(spark):
    inventory = spark.createDataFrame([("/s/closed/d/e",), ("/s/closed2/f",), ("/s/a",), ("/s/a",), ("x",)], "path string")
    due = spark.createDataFrame([("/s/closed/", "folder", ""), ("/s/a", "file", ""), ("/s/a", "folder", "")], journals.DUE_ROW)
    assert sorted(values(recovery.with_due(inventory, due), "path", "due")) == [
        ("/s/a", True), ("/s/a", True), ("/s/closed/d/e", True), ("/s/closed2/f", False), ("x", False),
    ]


def test_states_of_runs(spark, tmp_path):
    journal = journals.Journal(spark, str(tmp_path / "journal"))
    assert journal.unfinished() == [] and journal.due().count() == journal.taken().count() == 0
    runs = [journal.new_run(when) for when in (LATER, FIRST, LATER)]
    assert len(set(runs)) == 3
    for run, reached in zip(runs, (1, 2, 3)):
        for state in journals.STATES[:reached]:
            journal.mark(run, state, LATER if run != runs[1] else FIRST)
    assert [(run, state) for run, state, _ in journal.unfinished()] == [(runs[1], "written"), (runs[0], "planned")]
    assert journal.states().where(F.col("state") == "recorded").first()["run"] == runs[2]
