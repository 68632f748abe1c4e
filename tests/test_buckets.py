"""A ledger that lies bucketed by hash: joined in place, asked for possible contents only."""

import pytest
from helpers import sf, values
from pyspark.sql import functions as F
from test_ingest import FIRST, LATER, by_path, ingest, place, write  # noqa: F401
from test_plans import plan

from tidefold.functions import states
from tidefold.operators import lookups
from tidefold.operators.skew import HotKeys
from tidefold.session import Scratch
from tidefold.sources import buckets
from tidefold.sources import ledger as ledgers
from tidefold.verify import fixtures as fx

SF = sf("0.01")


@pytest.fixture(scope="module")
def laid_out(spark):
    ledger = buckets.create_bucketed(spark, f"{Scratch(spark).path}/ledger", 16, 2_000)
    worn = fx.worn(fx.ledger(spark, SF))
    for part in range(3):
        ledger.append(worn.where(F.col("size") % 3 == part))
    return ledger, worn


def sides(spark, text):
    """Whether an exchange stands between a join and the ledger's scan."""
    lines = text.split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "dest_path" in line or "tidefold_ledger" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-*|("))
    level, above = depth(lines[scan]), []
    for line in reversed(lines[:scan]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
            if "Join" in line:
                break
    return above


@pytest.mark.parametrize("stays", ["inner", "left", "anti"])
def test_the_ledger_side_has_no_exchange(spark, laid_out, stays):
    ledger, _ = laid_out
    rows = fx.inventory(spark, SF)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = {
            "inner": lambda: lookups.ledger_duplicates(rows, ledger.rows(), stay=True),
            "left": lambda: lookups.with_known_copy(rows, ledger.rows(), stay=True),
            "anti": lambda: lookups.insert_or_ignore(rows, ledger.rows(), stay=True),
        }[stays]()
        above = sides(spark, plan(joined))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" in above[-1] and not any("Exchange" in line for line in above)


@pytest.mark.parametrize("hot", [None, HotKeys("hash", ("none",), 3)])
def test_lookups_find_the_same_rows(spark, laid_out, hot):
    ledger, worn = laid_out
    rows = fx.inventory(spark, SF)
    if hot:
        # Any content may be called hot.
        some = rows.join(worn.select("hash").distinct(), "hash").limit(5)
        hot = HotKeys("hash", tuple(h for (h,) in values(some, "hash")) + ("absent",), 3)
    for lookup, columns in (
        (lookups.ledger_duplicates, ("path", "existing_path")),
        (lookups.insert_or_ignore, ("path",)),
        (lambda *a, **k: lookups.with_known_copy(a[0], a[1], None, *a[2:], **k), ("path", "known_path")),
    ):
        plain = sorted(values(lookup(rows, worn), *columns), key=str)
        assert plain and plain == sorted(values(lookup(rows, ledger.rows(), hot, stay=True), *columns), key=str)


@pytest.mark.parametrize("few", [0, 5, 100_000])
def test_the_filter_loses_no_known_content(spark, laid_out, few):
    ledger, worn = laid_out
    rows = fx.inventory(spark, SF)
    want = ledgers.known_hashes(worn).join(rows.select("hash").distinct(), "hash")
    assert sorted(values(ledger.known_among(rows, few), "hash", "dest_path")) == sorted(values(want, "hash", "dest_path"))


def test_the_filter_tells_most_new_contents(spark, laid_out):
    ledger, _ = laid_out
    new = spark.range(20_000).select(F.md5(F.col("id").cast("string")).alias("hash"))
    assert ledger.maybe_known(new).count() < 400
    assert ledger.known_among(new).count() == 0
    nulls = spark.createDataFrame([(None,)], "hash string")
    assert ledger.known_among(nulls).count() == 0


def test_a_filter_laid_out_too_small_changes_nothing(spark):
    ledger = buckets.create_bucketed(spark, f"{Scratch(spark).path}/ledger", 8, 1)
    known = fx.ledger(spark, SF)
    ledger.append(known)
    assert ledger.known_among(fx.inventory(spark, SF)).count() == known.count()


def test_layout_is_found_again_and_not_laid_over(spark, laid_out):
    ledger, worn = laid_out
    found = buckets.open_bucketed(spark, ledger.folder)
    assert (found.buckets, found.blocks) == (ledger.buckets, ledger.blocks)
    assert found.rows().count() == worn.count()
    with pytest.raises(ValueError):
        buckets.create_bucketed(spark, ledger.folder, 4, 10)
    assert buckets.open_bucketed(spark, ledger.folder + "/missing") is None


def test_runs_over_a_bucketed_ledger(spark, place):  # noqa: F811
    source, target = place
    buckets.create_bucketed(spark, target.ledger_table, 8, 1_000)
    first = ingest(spark, source, target, FIRST)
    assert first.summary.first()["copied"] == 3
    write(source, "c/new.jpg", b"new", "2023-09-15T00:00:00")
    write(source, "c/again.jpg", b"two", "2023-09-15T00:00:00")
    last = by_path(ingest(spark, source, target, LATER), source)
    assert last["c/new.jpg"][0] == states.COPIED and last["c/again.jpg"][0] == states.DUPLICATE
    ledger = ledgers.open_ledger(spark, target.ledger_table)
    assert ledger.count() == ledger.select("hash").distinct().count() == 4
