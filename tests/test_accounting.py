from datetime import datetime, timezone

import pytest
from helpers import values

from tidefold import schemas
from tidefold.functions import states
from tidefold.operators import accounting, report

AS_OF = datetime(2024, 3, 1, tzinfo=timezone.utc)
SCHEMA = (
    "path string, dest_path string, month string, hash string, size bigint, mtime timestamp, "
    "state string, existing_path string, error string, bytes_copied bigint"
)


def results(spark, *rows):
    when = datetime(2024, 1, 1, tzinfo=timezone.utc)
    return spark.createDataFrame(
        [
            (path, f"/d/2024-01{path}", "2024-01", "h", 10, when, state,
             "/d/known" if state == states.DUPLICATE else None, error,
             10 if state == states.COPIED else 0)
            for path, state, error in rows
        ],
        SCHEMA,
    )


def errors(spark, *paths):
    return spark.createDataFrame([(p, "denied") for p in paths], schemas.SCAN_ERRORS)


MIXED = (
    ("/s/a.jpg", states.COPIED, None),
    ("/s/b.jpg", states.DUPLICATE, None),
    ("/s/c.txt", states.SKIPPED_EXTENSION, None),
    ("/s/d.jpg", states.ERROR_HASH, "bad disk"),
    ("/s/e.jpg", states.ERROR_HASH, None),
)


def test_summary_and_reconciliation(spark):
    summary = accounting.accounting_summary(results(spark, *MIXED), errors(spark, "/s/x"))
    assert summary.first().asDict() == {
        "copied": 1, "skipped": 1, "duplicates": 1, "errors": 3, "total_bytes": 10,
        "total_files": 5, "walk_errors": 1,
    }
    got = accounting.reconciliation(summary).first()
    assert got["reconciled"] and not got["files_only"] and got["accounted"] == 6


def test_an_empty_run_sums_to_zero(spark):
    summary = accounting.accounting_summary(results(spark), errors(spark))
    assert set(summary.first().asDict().values()) == {0}
    assert accounting.outcome_bucket(summary).first()["outcome"] == "nothing"
    assert accounting.oldest_file_age(results(spark), AS_OF).first().asDict() == {
        "oldest_seconds": 86400, "oldest_age": "1 day",
    }


@pytest.mark.parametrize(
    "counts, expected",
    [
        ((80, 5, 4, 11), "errors"), ((0, 90, 0, 10), "nothing"), ((80, 5, 11, 4), "duplicates"),
        ((5, 91, 2, 2), "skipped"), ((50, 30, 10, 10), "clean"),
    ],
)
def test_outcome(spark, counts, expected):
    summary = spark.createDataFrame(
        [(*counts, 0, 100, 0)],
        "copied long, skipped long, duplicates long, errors long, total_bytes long, "
        "total_files long, walk_errors long",
    )
    assert accounting.outcome_bucket(summary).first()["outcome"] == expected


def ledger(spark, *days):
    rows = [("/a", "/d/a", f"h{d}", 1, 0, d) for d in days]
    return spark.createDataFrame(rows, schemas.LEDGER)


def test_context_and_recency(spark):
    january = datetime(2024, 1, 15, tzinfo=timezone.utc)
    february = datetime(2024, 2, 15, tzinfo=timezone.utc)
    mixed, none = results(spark, *MIXED), errors(spark)

    def told(rows, days, incremental=True):
        context = accounting.run_context(rows, none, ledger(spark, *days), incremental, AS_OF)
        return values(accounting.recency_bucket(context, AS_OF), "recency", "span")[0]

    assert told(mixed, []) == ("first", "2 months")
    assert told(mixed, [january]) == ("gap", "1 month")
    assert told(mixed, [january, february]) == ("recent", "15 days")
    assert told(mixed, [february], incremental=False)[0] == "first"
    assert told(results(spark, MIXED[0]), [february])[0] == "first"


def test_capacity(spark):
    columns = "files_found long, files_to_copy long, estimated_bytes long"
    estimate = spark.createDataFrame([(3, 2, 1024)], columns)
    need = 1024 + 100 * 1024 * 1024
    for available, enough in ((need, True), (need - 1, False)):
        got = accounting.capacity_gate(estimate, available).first()
        assert got["sufficient"] is enough and got["required_bytes"] == need
        assert got["required_gib"] == "0.10"


def test_report(spark):
    rows = report.report_rows(results(spark, *MIXED), errors(spark, "/s/x"), "/s", "/d")
    got = {row["path"]: row.asDict() for row in rows.collect()}
    assert {p: (r["status"], r["destination"], r["details"]) for p, r in got.items()} == {
        "s/a.jpg": ("copied", "d/2024-01/s/a.jpg", "Successfully copied"),
        "s/b.jpg": ("duplicate", "d/known", "Duplicate of existing file"),
        "s/c.txt": ("skipped", "", "skipped (extension)"),
        "s/d.jpg": ("error", "", "bad disk"),
        "s/e.jpg": ("error", "", "error (hash computation)"),
        "s/x": ("error", "", "denied"),
    }
    assert got["s/x"]["size_text"] == "-" and got["s/a.jpg"]["size_text"] == "10 B"


def test_report_order(spark):
    rows = report.report_rows(results(spark, *MIXED), errors(spark, "/s/x"), "/s", "/d")
    paths = [path for (path,) in values(report.report_sort(rows, "path", False), "path")]
    assert paths == sorted(paths, reverse=True)
    assert values(report.report_sort(rows, "size"), "size")[0] == (None,)
    with pytest.raises(ValueError):
        report.report_sort(rows, "color")


def test_badges_count_scan_errors(spark):
    got = accounting.report_badges(results(spark, *MIXED), errors(spark, "/s/x"), 5400.0).first()
    assert (got["total_files"], got["errors"], got["data_size"], got["time_taken"]) == (
        6, 3, "10 B", "1.5h",
    )


def test_error_rows(spark):
    got = report.error_rows(results(spark, *MIXED), errors(spark, "/s/x"))
    assert sorted(values(got, "message")) == [
        ("/s/d.jpg: bad disk",), ("/s/e.jpg: error (hash computation)",),
        ("walk error: /s/x: denied",),
    ]
