"""Totals of different contents, and a report searched by its index."""

import pytest
from helpers import sf, values
from pyspark.sql import functions as F

from tidefold.operators import filters, sketches
from tidefold.session import Scratch
from tidefold.sources import pathindex
from tidefold.verify import registry


def contents(spark, first, last, copies=1):
    """Contents whose sizes differ a hundredfold, each ``copies`` times."""
    return spark.range(first, last).select(
        F.md5(F.col("id").cast("string")).alias("hash"), (F.col("id") % 100 * 10 + 1).alias("size"),
        F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"),
    )


def told(sketched, k):
    return sketches.totals(sketched, k).first()


def test_few_contents_are_counted_exactly(spark):
    rows = contents(spark, 0, 300, copies=7)
    got = told(sketches.sketch(rows, 512), 512)
    assert tuple(got) == (300, sum(i % 100 * 10 + 1 for i in range(300)), 0.0, 0.0)
    nothing = spark.createDataFrame([(None, 5)], "hash string, size bigint")
    assert tuple(told(sketches.sketch(nothing, 16), 16)) == (0, 0, 0.0, 0.0)


def test_totals_lie_within_the_stated_error(spark):
    k, far = 400, 0
    for turn in range(6):
        first = turn * 100_000
        got = told(sketches.sketch(contents(spark, first, first + 20_000, copies=1 + turn % 2), k), k)
        size = sum(i % 100 * 10 + 1 for i in range(20_000))
        for estimate, error, true in ((got["contents"], got["contents_error"], 20_000), (got["bytes"], got["bytes_error"], size)):
            assert error < 0.1 * true and abs(estimate - true) <= 4 * error
            far += abs(estimate - true) > 2 * error
    assert far <= 2


def test_sketches_of_parts_merge_to_that_of_the_whole(spark):
    a, b = contents(spark, 0, 9_000, 2), contents(spark, 6_000, 15_000)
    whole = sketches.sketch(a.unionByName(b), 200)
    merged = sketches.merge(sketches.sketch(a, 200), sketches.sketch(b, 200), 200)
    assert sorted(values(whole, "value", "size")) == sorted(values(merged, "value", "size"))


def test_a_content_that_is_most_rows_hides_no_other(spark):
    hot = spark.range(50_000).select(F.lit("hot").alias("hash"), F.lit(9).cast("bigint").alias("size"))
    rows = hot.unionByName(contents(spark, 0, 2_000).drop("copy"))
    got = values(sketches.sketch(rows, 64), "value")
    every = values(rows.select(sketches.value(F.col("hash")).alias("value")).distinct(), "value")
    assert sorted(got) == sorted(every)[:64]


@pytest.fixture(scope="module")
def indexed(spark):
    report = registry.report_rows(spark, sf("0.01"))
    folder = f"{Scratch(spark).path}/report"
    pathindex.write_indexed(report, folder, 24)
    return report.cache(), folder


@pytest.mark.parametrize("term", ["", "im", "IMG_0000", "src1/b2", "not there at all", "/b0/img_000007", ".heic"])
@pytest.mark.parametrize("status", ["all", "skipped"])
def test_a_search_finds_what_a_scan_finds(spark, indexed, term, status):
    report, folder = indexed
    want = values(filters.report_filter(report, status, term), "path", "status")
    assert sorted(values(pathindex.search(spark, folder, status, term), "path", "status")) == sorted(want)


def test_a_search_reads_few_files(spark, indexed):
    _, folder = indexed
    every = pathindex.files_with(spark, folder, "src")
    assert len(every) > 15
    assert 0 < len(pathindex.files_with(spark, folder, "src17/b1")) <= 4
    found = pathindex.search(spark, folder, "all", "src17/b1")
    assert len(found.inputFiles()) <= 4 and found.count() > 0
