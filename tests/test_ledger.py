from datetime import datetime, timezone

from helpers import values

from tidefold import schemas
from tidefold.operators import filters
from tidefold.sources import ledger as ledgers

DAY = datetime(2024, 1, 10, tzinfo=timezone.utc)


def rows(spark, *pairs):
    return spark.createDataFrame(
        [(path, f"/d{path}", digest, 1, 0, DAY) for path, digest in pairs], schemas.LEDGER
    )


def test_first_of_each_new_content_is_added(spark):
    ledger = rows(spark, ("/old", "h0"))
    new = rows(spark, ("/a-b/x", "h1"), ("/a/z", "h1"), ("/q", "h0"), ("/r", "h2"))
    got = ledgers.new_ledger_rows(new, ledger)
    assert sorted(values(got, "src_path", "hash")) == [("/a/z", "h1"), ("/r", "h2")]


def test_append_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    new = rows(spark, ("/a", "h1"), ("/b", "h2"))
    for _ in range(2):
        ledgers.append_ledger(new, ledgers.open_ledger(spark, path), path)
    assert ledgers.open_ledger(spark, path).count() == 2


def test_null_hashes_are_not_loaded(spark):
    assert values(ledgers.known_hashes(rows(spark, ("/a", None), ("/b", "h"))), "hash") == [("h",)]


def inventory(spark):
    at = [datetime(2024, 1, 10, 0, 0, second, 900_000, tzinfo=timezone.utc) for second in (0, 1)]
    return spark.createDataFrame(
        [("/same", at[0], 1), ("/newer", at[1], 1), ("/undated", None, 1)], schemas.INVENTORY
    )


def test_watermark_is_compared_in_whole_seconds(spark):
    kept = filters.incremental_filter(inventory(spark), rows(spark, ("/a", "h")))
    assert sorted(values(kept, "path")) == [("/newer",), ("/undated",)]


def test_full_mode_and_an_empty_ledger_keep_everything(spark):
    full = filters.incremental_filter(inventory(spark), rows(spark, ("/a", "h")), False)
    fresh = filters.incremental_filter(inventory(spark), rows(spark))
    assert full.count() == fresh.count() == 3


def test_status(spark):
    as_of = datetime(2024, 1, 11, 1, 1, tzinfo=timezone.utc)
    got = ledgers.ledger_status(rows(spark, ("/a", "h")), as_of)
    assert values(got, *got.columns) == [
        ("2024-01-10 00:00:00", "1 days, 1 hours, 1 minutes ago", 1)
    ]
    assert values(ledgers.ledger_status(rows(spark), as_of), "last_backup", "unique_hashes") == [
        (None, 0)
    ]
