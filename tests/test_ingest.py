"""Whole runs over real files in a temporary folder."""

import hashlib
import os
from datetime import datetime, timedelta, timezone

import pytest
from helpers import sf, values
from pyspark.sql import functions as F

from tidefold import schemas
from tidefold.functions import states
from tidefold.operators import accounting
from tidefold.plans.ingest import Inputs, Target, run_folder, run_ingest, scan_inputs
from tidefold.session import Scratch
from tidefold.sources import ledger as ledgers
from tidefold.sources import listing, sinks
from tidefold.verify import fixtures as fx

FIRST = datetime(2023, 8, 1, tzinfo=timezone.utc)
LATER = datetime(2023, 9, 1, tzinfo=timezone.utc)
PLENTY = 1 << 40


def write(root, name, content, when="2023-06-15T10:30:45"):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as out:
        out.write(content)
    stamp = datetime.fromisoformat(when).replace(tzinfo=timezone.utc).timestamp()
    os.utime(path, (stamp, stamp))
    return path


@pytest.fixture
def place(tmp_path):
    source = str(tmp_path / "photos")
    write(source, "a/one.jpg", b"one")
    write(source, "a/two.mp4", b"two", "2023-04-20T14:15:30")
    write(source, "b/copy.JPG", b"one")
    write(source, "b/one.jpg", b"other")
    write(source, "b/notes.txt", b"text")
    write(source, ".hidden/three.png", b"three")
    tables = [str(tmp_path / name) for name in ("payload", "ledger", "report")]
    target = Target("/backup", *tables, source_folder=source)
    return source, target


def ingest(spark, source, target, as_of, tags=None, available=PLENTY, incremental=True):
    scratch = Scratch(spark)
    inputs = scan_inputs(spark, source, target, scratch, tags)
    return run_ingest(spark, inputs, target, as_of, available, incremental, scratch)


def by_path(outcome, source):
    rows = values(outcome.results, "path", "state", "dest_path")
    return {os.path.relpath(path, source): (state, dest) for path, state, dest in rows}


def test_a_first_run(spark, place):
    source, target = place
    tags = spark.createDataFrame(
        [(f"{source}/a/two.mp4", "format", "date", -1, "2022-12-31 23:00:00")], schemas.TAGS
    )
    outcome = ingest(spark, source, target, FIRST, tags)
    assert by_path(outcome, source) == {
        ".hidden/three.png": (states.COPIED, "/backup/2023-06/three.png"),
        "a/one.jpg": (states.COPIED, "/backup/2023-06/one.jpg"),
        "a/two.mp4": (states.COPIED, "/backup/2022-12/two.mp4"),
        "b/copy.JPG": (states.DUPLICATE, "/backup/2023-06/copy.JPG"),
        "b/one.jpg": (states.SKIPPED_DEST_EXISTS, "/backup/2023-06/one.jpg"),
        "b/notes.txt": (states.SKIPPED_EXTENSION, None),
    }
    assert outcome.summary.first().asDict() == {
        "copied": 3, "skipped": 2, "duplicates": 1, "errors": 0, "total_bytes": 11,
        "total_files": 6, "walk_errors": 0,
    }
    payload = spark.read.parquet(target.payload_table)
    got = {row["dest_path"]: bytes(row["content"]) for row in payload.collect()}
    assert got == {
        "/backup/2023-06/three.png": b"three", "/backup/2023-06/one.jpg": b"one",
        "/backup/2022-12/two.mp4": b"two",
    }
    assert {row["month"] for row in payload.select(F.col("month").cast("string")).collect()} == {
        "2023-06", "2022-12",
    }
    ledger = ledgers.open_ledger(spark, target.ledger_table)
    assert {row["hash"] for row in ledger.collect()} == {
        hashlib.md5(content).hexdigest() for content in (b"one", b"two", b"three")
    }
    told = {
        name: spark.read.parquet(f"{run_folder(target, FIRST)}/{name}").collect()
        for name in ("rows", "summary", "badges", "recency", "reconciliation", "errors", "by_state", "months")
    }
    assert told["reconciliation"][0]["reconciled"]
    assert sum(row["files"] for row in told["by_state"]) == told["summary"][0]["total_files"]
    shown = {(row["path"], row["destination"]) for row in told["rows"]}
    assert len(shown) == 6 and ("photos/a/one.jpg", "backup/2023-06/one.jpg") in shown
    assert told["summary"][0]["outcome"] == "duplicates"
    assert told["badges"][0]["data_size"] == "11 B"
    assert told["recency"][0].asDict() == {"recency": "first", "span": "3 months"}


@pytest.mark.parametrize("incremental", [True, False])
def test_a_second_run_copies_only_what_is_new(spark, place, incremental):
    source, target = place
    ingest(spark, source, target, FIRST)
    again = ingest(spark, source, target, LATER, incremental=incremental)
    assert again.summary.first()["copied"] == 0
    write(source, "c/new.jpg", b"new", "2023-09-15T00:00:00")
    write(source, "c/again.jpg", b"two", "2023-09-15T00:00:00")
    last = by_path(ingest(spark, source, target, LATER, incremental=incremental), source)
    assert last["c/new.jpg"][0] == states.COPIED
    assert last["c/again.jpg"][0] == states.DUPLICATE
    early = states.SKIPPED_INCREMENTAL if incremental else states.SKIPPED_DEST_EXISTS
    assert last["a/one.jpg"][0] == early
    ledger = ledgers.open_ledger(spark, target.ledger_table)
    assert ledger.count() == ledger.select("hash").distinct().count() == 4


@pytest.mark.parametrize("incremental", [True, False])
def test_documents_with_a_payload_table(spark, tmp_path, incremental):
    """A run over tables writes each content once, and a second one nothing."""
    tables = [str(tmp_path / name) for name in ("payload", "ledger", "report")]
    target = Target(fx.DEST, *tables)
    payload = fx.base(spark, sf("0.001")).select("path", "text")
    copied = []
    for as_of in (fx.AS_OF, fx.AS_OF + timedelta(days=1)):
        inputs = Inputs(
            fx.faulty_inventory(spark, sf("0.001")),
            fx.tags(spark, sf("0.001")),
            listing.taken_keys(spark, target.payload_table),
            ledgers.open_ledger(spark, target.ledger_table),
            fx.scan_errors(spark, sf("0.001")),
            payload,
        )
        outcome = run_ingest(spark, inputs, target, as_of, PLENTY, incremental)
        copied.append(outcome.summary.first()["copied"])
        assert accounting.reconciliation(outcome.summary).first()["reconciled"]
    assert copied[0] > 100 and copied[1] == 0
    written = spark.read.parquet(target.payload_table)
    ledger = ledgers.open_ledger(spark, target.ledger_table)
    for column in ("dest_path", "hash"):
        assert written.select(column).distinct().count() == written.count() == copied[0]
    assert written.where(F.md5("text") != F.col("hash")).count() == 0
    assert ledger.join(written, ["hash", "dest_path"]).count() == ledger.count() == copied[0]


def test_another_digest(spark, place):
    source, target = place
    scratch = Scratch(spark)
    inputs = scan_inputs(spark, source, target, scratch)
    run_ingest(spark, inputs, target, FIRST, PLENTY, scratch=scratch, digest="sha256")
    hashes = {row["hash"] for row in ledgers.open_ledger(spark, target.ledger_table).collect()}
    assert hashlib.sha256(b"two").hexdigest() in hashes


def test_too_little_space_ends_the_run(spark, place):
    source, target = place
    outcome = ingest(spark, source, target, FIRST, available=100 * 1024 * 1024)
    assert not outcome.gate.first()["sufficient"] and outcome.results is None
    assert not os.path.exists(target.ledger_table)


def test_unreadable_content_is_an_error_and_takes_nothing(spark, place):
    source, target = place
    os.symlink(f"{source}/gone.jpg", f"{source}/a/broken.jpg")
    outcome = ingest(spark, source, target, FIRST)
    assert by_path(outcome, source)["a/broken.jpg"][0] == states.ERROR_HASH
    assert outcome.summary.first()["errors"] == 1


def test_walk_keeps_hidden_names_and_records_what_it_cannot_read(spark, tmp_path):
    root = str(tmp_path / "tree")
    for name in ("x/y/z/deep.jpg", ".dot", "_under/file", "plain"):
        write(root, name, b"12")
    os.symlink(root, os.path.join(root, "x", "loop"))
    found, errors = listing.walk_tree(spark, root, Scratch(spark))
    names = {os.path.relpath(path, root) for (path,) in values(found, "path")}
    assert names == {"x/y/z/deep.jpg", ".dot", "_under/file", "plain", "x/loop"}
    assert errors.count() == 0
    assert found.where("path like '%deep.jpg'").first()["mtime"] is not None

    found, errors = listing.walk_tree(spark, root + "/missing", Scratch(spark))
    assert found.count() == 0
    assert values(errors, "path", "message") == [
        (root + "/missing", "No such file or directory")
    ]


def test_inventory_scan_reads_no_content(spark, tmp_path):
    root = str(tmp_path / "scan")
    path = write(root, "in/one.jpg", b"one")
    write(root, "two.txt", b"2")
    scanned = listing.inventory_scan(spark, root)
    assert sorted(values(scanned, "path", "size")) == sorted([(path, 3), (f"{root}/two.txt", 1)])
    assert values(listing.inventory_scan(spark, root, "*.jpg"), "path") == [(path,)]
    assert "content" not in scanned._jdf.queryExecution().executedPlan().toString()


def test_digests_of_files_and_columns_agree(spark, tmp_path):
    path = write(str(tmp_path), "a.bin", b"x" * 3_000_000)
    rows = [(path, 3_000_000), ("/no/such", None)]
    files = spark.createDataFrame(rows, "path string, size bigint")
    for digest in listing.DIGESTS:
        got = dict(values(listing.hash_files(files, digest), "path", "hash"))
        assert got == {path: hashlib.new(digest, b"x" * 3_000_000).hexdigest(), "/no/such": None}
        binary = spark.read.format("binaryFile").load(path)
        column = binary.select(listing.content_digest(F.col("content"), digest))
        assert column.first()[0] == got[path]


def test_tasks_are_cut_by_bytes_of_content(spark):
    """A few large files beside many small ones: no task gets far more than its share."""
    most = 100 << 20
    sizes = [90 << 20] * 12 + [1 << 20] * 300 + [None] * 20
    rows = [(f"/f/{n}", size, f"m{n % 3}") for n, size in enumerate(sizes)]
    files = spark.createDataFrame(rows, "path string, size bigint, month string")
    spread = listing.spread_by_content(files, ("month",), task_bytes=most)
    tasks = spread.groupBy(F.spark_partition_id().alias("task")).agg(
        F.sum("size").alias("bytes"), F.count_distinct("month").alias("months")
    ).collect()
    assert sorted(values(spread, "path")) == sorted((path,) for path, _, _ in rows)
    assert len(tasks) > 10 and max(row["bytes"] for row in tasks) <= most + (90 << 20)
    assert sum(row["months"] for row in tasks) <= len(tasks) + 3


def test_content_larger_than_a_part_comes_in_order(spark, tmp_path):
    content = bytes(range(256)) * 10
    big, empty = write(str(tmp_path), "big", content), write(str(tmp_path), "empty", b"")
    rows = spark.createDataFrame([(big,), (empty,)], "path string")
    parts = sinks.with_content(rows, part_bytes=1000).orderBy("path", "part").collect()
    assert b"".join(bytes(row["content"]) for row in parts if row["path"] == big) == content
    assert [bytes(row["content"]) for row in parts if row["path"] == empty] == [b""]


def test_report_formats(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "path string, size bigint")
    for form in ("parquet", "json", "csv"):
        folder = str(tmp_path / form)
        sinks.write_report(rows, folder, form)
        back = spark.read.option("header", True).schema(rows.schema).format(form).load(folder)
        assert values(back, "path", "size") == [("a", 1)]


def test_rows_without_payload_are_errors_and_repeated_payload_is_written_once(spark, tmp_path):
    tables = [str(tmp_path / name) for name in ("payload", "ledger", "report")]
    target = Target("/dest", *tables)
    inventory = spark.createDataFrame(
        # The row without payload comes first at its destination and for its content.
        [("/a/x.jpg", FIRST, 1, "h1"), ("/b/x.jpg", FIRST, 1, "h1"), ("/c/y.jpg", FIRST, 1, "h2")],
        "path string, mtime timestamp, size bigint, hash string",
    )
    payload = spark.createDataFrame(
        [("/b/x.jpg", "one"), ("/b/x.jpg", "one"), ("/c/y.jpg", "two")], "path string, text string"
    )
    errors = spark.createDataFrame([], "path string, message string")
    inputs = Inputs(
        inventory, spark.createDataFrame([], schemas.TAGS), listing.taken_keys(spark, target.payload_table),
        ledgers.open_ledger(spark, target.ledger_table), errors, payload,
    )
    outcome = run_ingest(spark, inputs, target, LATER, PLENTY)
    states_of = dict(values(outcome.results, "path", "state"))
    assert states_of == {"/a/x.jpg": states.ERROR_COPY, "/b/x.jpg": states.COPIED, "/c/y.jpg": states.COPIED}
    written = values(spark.read.parquet(target.payload_table), "path")
    ledger = values(ledgers.open_ledger(spark, target.ledger_table), "src_path")
    assert sorted(written) == sorted(ledger) == [("/b/x.jpg",), ("/c/y.jpg",)]
    assert outcome.summary.first()["copied"] == 2 and outcome.summary.first()["errors"] == 1
    told = values(spark.read.parquet(f"{run_folder(target, LATER)}/errors"), *spark.read.parquet(f"{run_folder(target, LATER)}/errors").columns)
    assert len(told) == 1 and any("/a/x.jpg" in str(cell) for cell in told[0])


def test_files_that_fail_between_hashing_and_copying(spark, place, monkeypatch):
    """One removed, one changed, one locked away: the run ends and all counts agree."""
    source, target = place
    many = [write(source, f"d/{n}.jpg", b"%d" % n) for n in range(5)]
    copy = write(source, "e/again.jpg", b"0")
    accepted = sinks.accepted

    def then_spoil(results):
        rows = accepted(results)
        if os.path.exists(many[0]):
            os.remove(many[0])
            write(source, "d/1.jpg", b"new content")
            os.remove(many[2])
            os.mkdir(many[2])
        return rows

    monkeypatch.setattr(sinks, "accepted", then_spoil)
    outcome = ingest(spark, source, target, FIRST)
    told = {path: (state, error) for path, state, error in values(outcome.results, "path", "state", "error")}
    assert told[many[0]] == (states.ERROR_COPY, "No such file or directory")
    assert told[many[1]] == (states.ERROR_COPY, "content changed since it was hashed")
    assert told[many[2]] == (states.ERROR_COPY, "Is a directory")
    assert told[copy] == (states.ERROR_COPY, f"gave way to a file that was not copied: {many[0]}")
    assert told[many[3]][0] == told[many[4]][0] == states.COPIED
    summary = outcome.summary.first()
    assert summary["errors"] == 4 and summary["copied"] == 5
    assert accounting.reconciliation(outcome.summary).first()["reconciled"]
    written = spark.read.parquet(target.payload_table).select("dest_path", "hash", F.md5("content").alias("md5"))
    ledger = ledgers.open_ledger(spark, target.ledger_table)
    assert sorted(values(ledger, "dest_path", "hash")) == sorted(values(written, "dest_path", "md5"))
    assert ledger.count() == written.where("hash = md5").count() == 5


def test_a_spoiled_file_of_many_parts_leaves_no_part(spark, tmp_path):
    good, bad = write(str(tmp_path), "good", b"ab" * 999), write(str(tmp_path), "bad", b"cd" * 999)
    planned = [(path, hashlib.md5(b"ab" * 999).hexdigest()) for path in (good, bad)]
    rows = spark.createDataFrame(planned + [("/no/such", "h")], "path string, hash string")
    parts = sinks.with_content(rows, part_bytes=100).groupBy("path").count()
    assert values(parts, "path", "count") == [(good, 20)]


def test_each_run_leaves_a_report(spark, place):
    source, target = place
    for as_of in (FIRST, LATER):
        ingest(spark, source, target, as_of)
    copied = [spark.read.parquet(f"{run_folder(target, as_of)}/summary").first()["copied"] for as_of in (FIRST, LATER)]
    assert copied[0] > 0 and copied[1] == 0


def test_a_hash_twice_in_the_ledger_doubles_nothing(spark):
    ledger = spark.createDataFrame(
        [("/o", path, "h", 1, 0, FIRST) for path in ("/d/2", "/d/1")] + [("/o", "/d/0", None, 1, 0, FIRST)], schemas.LEDGER
    )
    from tidefold.operators import lookups

    rows = spark.createDataFrame([("/n", "h")], "path string, hash string")
    assert values(lookups.ledger_duplicates(rows, ledger), "path", "existing_path") == [("/n", "/d/1")]
    assert values(lookups.with_known_copy(rows, ledger), "path", "known_path") == [("/n", "/d/1")]
    assert ledgers.ledger_status(ledger, LATER).first()["unique_hashes"] == 1


def test_a_name_that_is_not_utf8_is_an_error_row(spark, tmp_path):
    root = str(tmp_path / "names")
    write(root, "ok.jpg", b"one")
    with open(os.path.join(os.fsencode(root), b"bad\xff.jpg"), "wb") as out:
        out.write(b"two")
    files, errors = listing.walk_tree(spark, root, Scratch(spark))
    assert values(files, "path") == [(f"{root}/ok.jpg",)]
    assert [message for _, message in values(errors, "path", "message")] == ["name is not UTF-8"]
