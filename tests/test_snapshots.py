"""Listings of two runs: what changed, what only lies elsewhere, what need not be hashed."""

import hashlib
import os
from dataclasses import replace
from datetime import datetime, timezone

from helpers import values
from test_ingest import FIRST, LATER, by_path, ingest, place, write  # noqa: F401

from tidefold import schemas
from tidefold.functions import states
from tidefold.operators import snapshots
from tidefold.operators.skew import HotKeys
from tidefold.sources import listing as listings

T1, T2 = (datetime(2024, 1, day, tzinfo=timezone.utc) for day in (1, 2))


def listing(spark, *rows):
    return spark.createDataFrame(rows, snapshots.SNAPSHOT)


BEFORE = [
    ("/a/same", 1, T1, "h1"), ("/a/changed", 1, T1, "h2"), ("/a/touched", 1, T1, "h3"), ("/a/gone", 1, T1, "h4"),
    ("/a/moved", 5, T1, "h5"), ("/a/twin", 5, T1, "h6"), ("/b/twin", 5, T1, "h6"), ("/a/null", 1, None, None),
    ("/a/unread", 3, T1, None),
]
AFTER = [
    ("/a/same", 1, T1, "h1"), ("/a/changed", 1, T1, "x2"), ("/a/touched", 1, T2, "h3"), ("/c/new", 1, T1, "n"),
    ("/c/moved", 5, T1, "h5"), ("/c/moved2", 5, T2, "h5"), ("/c/twin", 5, T1, "h6"), ("/a/null", 1, None, None),
    ("/c/unread", 3, T1, None),
]


def test_kinds_of_change(spark):
    want = {
        "/a/same": ("same", None), "/a/changed": ("changed", None), "/a/touched": ("changed", None),
        "/a/gone": ("gone", None), "/c/new": ("added", None), "/c/moved": ("moved", "/a/moved"),
        "/c/moved2": ("moved", "/a/moved"), "/a/moved": ("left", "/c/moved"), "/c/twin": ("moved", "/a/twin"),
        "/a/twin": ("left", "/c/twin"), "/b/twin": ("left", "/c/twin"), "/a/null": ("same", None),
        "/a/unread": ("gone", None), "/c/unread": ("added", None),
    }
    for hot in (None, HotKeys("hash", ("h5", "h6"), 3)):
        got = snapshots.difference(listing(spark, *BEFORE), listing(spark, *AFTER), hot)
        assert {p: (c, o) for p, c, o in values(got, "path", "change", "other_path")} == want


def test_empty_listings(spark):
    some, none = listing(spark, *AFTER), listing(spark)
    assert {c for (c,) in values(snapshots.difference(none, some), "change")} == {"added"}
    assert {c for (c,) in values(snapshots.difference(some, none), "change")} == {"gone"}
    assert snapshots.difference(none, none).count() == 0


def test_hashes_are_carried_only_where_the_file_is_known(spark):
    listed = listing(spark, *AFTER).drop("hash")
    got = dict(values(snapshots.with_carried_hash(listed, listing(spark, *BEFORE)), "path", "hash"))
    # Two that are gone had the name, size and time of /c/twin: it must be read.
    assert got == {
        "/a/same": "h1", "/a/changed": "h2", "/a/touched": None, "/c/new": None, "/c/moved": "h5", "/c/moved2": None,
        "/c/twin": None, "/a/null": None, "/c/unread": None,
    }


def test_a_hot_content_is_not_paired(spark):
    """Thousands of empty files on either side: one row each, by the least path."""
    before = spark.range(3_000).selectExpr("concat('/old/', id) AS path", "0L AS size", "timestamp'2024-01-01' AS mtime", "'e' AS hash")
    after = spark.range(3_000).selectExpr("concat('/new/', id) AS path", "0L AS size", "timestamp'2024-01-01' AS mtime", "'e' AS hash")
    got = snapshots.difference(before, after)
    assert sorted(values(got.groupBy("change", "other_path").count(), "change", "other_path", "count")) == [
        ("left", "/new/0", 3_000), ("moved", "/old/0", 3_000),
    ]


def test_moved_files_are_not_hashed_again(spark, place, monkeypatch):  # noqa: F811
    source, target = place
    target = replace(target, keep_snapshots=True)
    ingest(spark, source, target, FIRST)
    os.makedirs(f"{source}/z")
    os.rename(f"{source}/a/two.mp4", f"{source}/z/two.mp4")
    # Its month tells another destination, so only its content is known.
    write(source, "z/new.jpg", b"new", "2023-09-15T00:00:00")
    asked, real = [], listings.hash_files
    monkeypatch.setattr(listings, "hash_files", lambda files, *a: (asked.extend(values(files, "path")), real(files, *a))[1])
    tags = spark.createDataFrame(
        [(f"{source}/z/two.mp4", "format", "date", -1, "2021-05-05 00:00:00")], schemas.TAGS
    )
    got = by_path(ingest(spark, source, target, LATER, tags, incremental=False), source)
    assert got["z/two.mp4"][0] == states.DUPLICATE and got["z/new.jpg"][0] == states.COPIED
    assert [path for (path,) in asked] == [f"{source}/z/new.jpg"]
    left = dict(values(target.journal(spark).last("snapshot", snapshots.SNAPSHOT), "path", "hash"))
    assert left[f"{source}/z/two.mp4"] == hashlib.md5(b"two").hexdigest()
    assert left[f"{source}/a/one.jpg"] == hashlib.md5(b"one").hexdigest()
