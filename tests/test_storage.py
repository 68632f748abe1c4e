"""Listing, reading and hashing through file systems, and trees of hashes."""

import hashlib
import os

import pytest
from helpers import values
from test_ingest import write

from tidefold.session import Scratch
from tidefold.sources import listing, storage, treehash


def walked(spark, root):
    found, errors = listing.walk_tree(spark, root, Scratch(spark))
    return sorted(values(found, "path", "size")), values(errors, "path", "message")


def test_a_walk_over_several_roots_records_what_is_not_there(spark, tmp_path):
    one, two = write(str(tmp_path), "a/x", b"12"), write(str(tmp_path), "b/y/z", b"345")
    roots = [(f"{tmp_path}/a",), (f"{tmp_path}/b",), (f"{tmp_path}/b",), (f"{tmp_path}/gone",), (one,)]
    found, errors = walked(spark, spark.createDataFrame(roots, "path string"))
    assert found == [(one, 2), (two, 3)]
    assert sorted(errors) == sorted([(one, "Not a directory"), (f"{tmp_path}/gone", "No such file or directory")])


def test_no_roots(spark):
    found, errors = walked(spark, spark.createDataFrame([], "path string"))
    assert found == errors == []


def test_a_flat_folder_is_cut_by_names(spark, tmp_path):
    for n in range(300):
        write(str(tmp_path), f"{n:03}", b"x" * n)
    scratch = Scratch(spark)
    found, _ = listing.walk_tree(spark, str(tmp_path), scratch)
    assert sorted(values(found, "path", "size")) == [(f"{tmp_path}/{n:03}", n) for n in range(300)]
    # Their facts were asked for by several tasks.
    facts = [name for name in os.listdir(f"{scratch.path.removeprefix('file:')}/walk-facts") if name.endswith(".parquet")]
    assert len(facts) > 4


def test_a_file_that_goes_after_its_name_was_read_is_an_error(tmp_path):
    assert storage.file_facts(f"{tmp_path}/gone") == ("error", f"{tmp_path}/gone", None, None, "No such file or directory")


def test_a_file_system_by_uri(tmp_path, monkeypatch):
    """The way of object stores, over the one file system of pyarrow that is at hand."""
    path = write(str(tmp_path), "a/.x", b"0123456789")
    monkeypatch.setattr(storage, "mounted", lambda path: None)
    entries = list(storage.list_folder(f"file://{tmp_path}"))
    assert entries == [("folder", f"file://{tmp_path}/a", None, None, None)]
    (entry,) = storage.list_folder(f"file://{tmp_path}/a")
    assert entry[:2] == ("file", f"file://{path}") and entry[3] == 10 and entry[2] == os.stat(path).st_mtime_ns // 1000
    with storage.open_content(f"file://{path}") as content:
        assert content.read(4) == b"0123"
    with storage.open_at(f"file://{path}", 6) as content:
        assert content.read(9) == b"6789"
    (error,) = storage.list_folder(f"file://{tmp_path}/gone")
    assert error[0] == "error" and error[4]


def test_uris_of_mounts_are_mounts(spark, tmp_path):
    path = write(str(tmp_path), "a/x", b"12")
    found, _ = walked(spark, f"file://{tmp_path}")
    assert found == [(path, 2)]


def tree(content, part_bytes, fan):
    parts = [content[i : i + part_bytes] for i in range(0, len(content), part_bytes)] or [b""]
    level = [hashlib.sha256(b"l" + part).hexdigest() for part in parts]
    while len(level) > 1:
        level = [hashlib.sha256(("n" + "".join(level[i : i + fan])).encode()).hexdigest() for i in range(0, len(level), fan)]
    return level[0]


@pytest.mark.parametrize("part_bytes, fan", [(10, 2), (7, 3), (1000, 8), (64, 1024)])
def test_tree_digests_of_files_and_columns(spark, tmp_path, part_bytes, fan):
    contents = {name: (b"abc%d-" % n) * n for n, name in enumerate("pqrstu")} | {"big": bytes(range(256)) * 4}
    paths = {write(str(tmp_path), name, content): content for name, content in contents.items()}
    files = spark.createDataFrame([(p, len(c)) for p, c in paths.items()], "path string, size bigint")
    got = dict(values(treehash.tree_hash_files(files.repartition(3), part_bytes, fan), "path", "hash"))
    assert got == {path: tree(content, part_bytes, fan) for path, content in paths.items()}
    rows = spark.createDataFrame([(p, bytearray(c)) for p, c in paths.items()] + [("null", None)], "path string, c binary")
    assert dict(values(treehash.tree_hash(rows, "path", "c", part_bytes, fan), "path", "hash")) == got


def test_a_large_file_is_as_many_units_as_parts(spark, tmp_path):
    path = write(str(tmp_path), "large", b"z" * 100_000)
    parts = treehash.cut(spark.createDataFrame([(path, 100_000)], "path string, size bigint"), 1_000)
    assert parts.count() == 100
    hashed = treehash.hash_parts(parts)
    assert hashed.count() == 100 and hashed.rdd.getNumPartitions() >= 8


def test_files_that_changed_or_went_have_no_digest(spark, tmp_path):
    short, long = write(str(tmp_path), "short", b"1" * 50), write(str(tmp_path), "long", b"1" * 70)
    files = [(short, 60), (long, 60), (str(tmp_path / "gone"), 25), (write(str(tmp_path), "empty", b""), None)]
    got = treehash.tree_hash_files(spark.createDataFrame(files, "path string, size bigint"), 20, 4)
    assert {os.path.basename(p): (h, e) for p, h, e in values(got, "path", "hash", "read_error")} == {
        "short": (None, treehash.CHANGED), "long": (None, treehash.CHANGED), "gone": (None, "No such file or directory"),
        "empty": (hashlib.sha256(b"l").hexdigest(), None),
    }


def test_sums_of_bytes_beyond_petabytes(spark):
    """Task numbers are right where the sum of bytes times the tasks leaves 64 bits."""
    big = 1 << 44
    files = spark.range(400).selectExpr("concat('/f/', id) AS path", f"{big}L AS size", "'m' AS month")
    spread = listing.spread_by_content(files, ("month",), task_bytes=1 << 46)
    tasks = spread.groupBy(spread_id().alias("task")).count().collect()
    assert spread.count() == 400 and len(tasks) == 100 and max(row["count"] for row in tasks) <= 5
    # 6 PB in tasks of 1 GiB: not run, but the numbers are made.
    many = listing.spread_by_content(files, ("month",), task_bytes=1 << 30)
    assert "_task" in many._jdf.queryExecution().analyzed().toString()


def spread_id():
    from pyspark.sql import functions as F

    return F.spark_partition_id()
