import base64
import gzip
import hashlib
import os

import pytest

from tidefold.llm import warc
from tidefold.llm.warc import parse_archive, read_archives, read_manifest, write_archives
from tidefold.session import Scratch

PAGES = "page_id long, url string, html string"


def written(spark, rows, **options):
    scratch = Scratch(spark)
    folder = f"{scratch.path}/archives"
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS _digest", "1 AS _shard")
    manifest = write_archives(df, folder, scratch=scratch, **options)
    return manifest, folder


def test_round_trip(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    rows += [(10_000 + i, "http://again/", rows[i % 3][2]) for i in range(40)]
    manifest, folder = written(spark, rows, roll_bytes=20_000)
    assert manifest.count() > 5
    first = {}
    for page_id, _, html in rows:
        first[html] = min(page_id, first.get(html, page_id))
    want = {}
    for page_id, _, html in rows:
        data = html.encode()
        label = base64.b32encode(hashlib.sha1(data).digest()).decode()
        own = first[html] == page_id
        want[page_id] = (len(data), label, "response" if own else "revisit", None if own else first[html])
    got = read_archives(manifest, folder).collect()
    assert len(got) == len(rows)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want


def test_hostile_rows(spark):
    rows = [
        (1, "u", "a"), (2, None, "a"), (2, "v", "a"), (None, "w", "a"), (None, "w", "q"), (None, "w", "q"),
        (5, "x\r\ny z", None), (6, "é", ""), (7, "u", "ß" * 400_000),
    ]
    manifest, folder = written(spark, rows)
    got = [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in read_archives(manifest, folder).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, 1, "response", None), (2, 1, "revisit", 1), (2, 1, "revisit", 1), (None, 1, "revisit", 1),
        (None, 1, "response", None), (None, 1, "response", None),
        (5, 0, "response", None), (6, 0, "revisit", 5), (7, 800_000, "response", None),
    ], key=repr)
    manifest, folder = written(spark, [])
    assert manifest.count() == 0 and read_archives(manifest, folder).count() == 0


def test_same_bytes_whatever_the_partitions(spark):
    rows = [(i, f"http://h/{i}", f"page {i % 7} " * 50) for i in range(300)]
    sums = []
    for order in (rows, rows[::-1]):
        manifest, folder = written(spark, order, roll_bytes=4_000)
        sums.append(sorted((r["name"], r["sha256"]) for r in manifest.collect()))
        names = {name for name, _ in sums[-1]}
        assert {n for n in os.listdir(folder.removeprefix("file:")) if not n.startswith(".")} == names
    assert sums[0] == sums[1]


def test_each_record_is_a_member(spark):
    manifest, folder = written(spark, [(1, "http://h/", "body")])
    name = manifest.first()["name"]
    with gzip.open(os.path.join(folder.removeprefix("file:"), name)) as stream:
        kinds = [headers["WARC-Type"] for headers, _ in parse_archive(stream)]
    assert kinds == ["warcinfo", "response"]


def test_small_payloads_may_be_stored_each(spark):
    manifest, folder = written(spark, [(1, "u", "ab"), (2, "u", "ab")], min_revisit_bytes=3)
    assert {r["record_type"] for r in read_archives(manifest, folder).collect()} == {"response"}


def payloads(spark, folder):
    return {r["page_id"]: r["payload_bytes"] for r in read_archives(read_manifest(spark, folder), folder).collect()}


def test_writing_again_keeps_nothing_old_in_silence(spark):
    scratch = Scratch(spark)
    folder = f"{scratch.path}/archives"
    pages = lambda *rows: spark.createDataFrame(list(rows), PAGES)
    old = pages((1, "u", "old"), *((i, "u", f"page {i}") for i in range(2, 60)))
    write_archives(old, folder, roll_bytes=2_000)
    names = {r["name"] for r in read_manifest(spark, folder).collect()}
    assert len(names) > 2
    # The same rows again are the same files.
    write_archives(old, folder, roll_bytes=2_000)
    assert {r["name"] for r in read_manifest(spark, folder).collect()} == names
    new = pages((1, "u", "new content"))
    with pytest.raises(Exception, match="holds other content"):
        write_archives(new, folder)
    assert payloads(spark, folder)[1] == 3
    write_archives(new, folder, replace=True)
    assert payloads(spark, folder) == {1: 11}
    left = {n for n in os.listdir(folder.removeprefix("file:")) if n.endswith(".gz")}
    assert left == {r["name"] for r in read_manifest(spark, folder).collect()}


def test_a_write_that_ended_half_way_is_completed(spark):
    scratch = Scratch(spark)
    folder = f"{scratch.path}/archives"
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(60)], PAGES)
    whole = {r["name"]: r["sha256"] for r in write_archives(pages, folder, roll_bytes=2_000).collect()}
    root = folder.removeprefix("file:")
    # As if the writer had died after some moves, before the manifest.
    for name in sorted(whole)[::2]:
        os.remove(f"{root}/{name}")
    os.remove(f"{root}/.manifest/MANIFEST")
    assert read_manifest(spark, folder) is None
    again = {r["name"]: r["sha256"] for r in write_archives(pages, folder, roll_bytes=2_000).collect()}
    assert again == whole and len(payloads(spark, folder)) == 60


def test_writers_do_not_share_temporary_names(spark):
    scratch = Scratch(spark)
    folder = f"{scratch.path}/archives"
    root = folder.removeprefix("file:")
    os.makedirs(f"{root}/.temporary/another")
    with open(f"{root}/.temporary/another/file", "w") as out:
        out.write("of a writer at work")
    write_archives(spark.createDataFrame([(1, "u", "a")], PAGES), folder)
    assert os.listdir(f"{root}/.temporary/another") == ["file"] and os.listdir(f"{root}/.temporary") == ["another"]


def test_files_are_checked_against_the_manifest(spark):
    manifest, folder = written(spark, [(1, "u", "one")])
    _, other = written(spark, [(1, "u", "two")])
    name = manifest.first()["name"]
    # A whole archive, of other content.
    os.replace(f"{other.removeprefix('file:')}/{name}", f"{folder.removeprefix('file:')}/{name}")
    with pytest.raises(Exception, match="not the file that the manifest names"):
        read_archives(manifest, folder).collect()


def test_ranges_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 3_000)
    text = lambda i: f"{i} " + "x" * 500
    rows = [(i, "u", text(i)) for i in range(40)] + [(7, "u", text(i)) for i in range(100, 130)]
    rows += [(None, "u", text(i)) for i in range(200, 230)] + [(None, "u", text(3)), (7, "u", text(100))]
    manifest, folder = written(spark, rows)
    # One id, and rows without one, are several ranges too.
    assert manifest.count() > 20 and max(r["records"] for r in manifest.collect()) <= 16
    got = read_archives(manifest, folder).collect()
    assert len(got) == len(rows)
    revisits = sorted(((r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"), key=repr)
    assert revisits == [(7, 7), (None, 3)]
