"""What the plans must and must not hold, whatever the size of the data."""

import re

import pytest
from helpers import sf
from pyspark.sql import functions as F

from tidefold.functions.paths import walk_key
from tidefold.operators import accounting, classify, dating, filters
from tidefold.operators.placement import _first_per, number_in_walk_order
from tidefold.session import Scratch, shared_folder
from tidefold.sources import ledger as ledgers
from tidefold.sources import listing
from tidefold.verify import fixtures as fx
from tidefold.verify.registry import QUERIES

SF = sf("0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_needs_a_cross_join_a_window_or_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "Window", "Python", "Pandas"):
        assert operator not in text


def test_only_needed_columns_are_read(spark):
    text = plan(QUERIES["normalize_ext"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in text


def test_listing_filters_reach_the_listing(spark):
    scanned = listing.inventory_scan(spark, SF).where("size > 10 and mtime > '2020-01-01'")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    explained = scanned._jdf.queryExecution().explainString(mode)
    pushed = re.search(r"PushedFilters: \[(.*)\]", explained).group(1)
    assert "GreaterThan(length,10)" in pushed and "GreaterThan(modificationTime" in pushed


def test_tag_names_reach_the_scan(spark):
    tags = Scratch(spark).save(fx.tags(spark, SF), "tags")
    text = plan(dating.best_tag_date(tags))
    assert "In(tag, [DateTime,DateTimeDigitized" in text
    assert "SortAggregate" not in text and text.count("Exchange") == 1


def test_the_watermark_is_a_scalar_not_a_join(spark):
    kept = filters.incremental_filter(fx.inventory(spark, SF), fx.ledger(spark, SF))
    text = plan(kept)
    assert "Subquery" in text and "Join" not in text


def test_placement_aggregates_in_place_before_its_shuffle(spark):
    rows = fx.inventory(spark, SF).select("path", "hash")
    table = Scratch(spark).save(number_in_walk_order(rows), "numbered")
    text = plan(_first_per(table, "hash"))
    assert "partial_min(place" in text and "SortAggregate" not in text


def test_totals_equal_the_sum_of_planned_rows_and_combine_first(spark):
    run = fx.run(spark, SF)
    inputs = (run.inventory, run.listing, run.mark, fx.DEST)
    totals = classify.plan_totals(*inputs)
    rows = accounting.plan_estimate(classify.plan_classification(*inputs))
    assert totals.collect() == rows.collect()
    assert "partial_count" in plan(totals) and "Union" not in plan(totals)


def test_places_follow_the_walk(spark):
    rows = number_in_walk_order(fx.inventory(spark, SF).repartition(5).select("path"))
    by_place = [row[0] for row in Scratch(spark).save(rows, "n").orderBy("place").collect()]
    assert by_place == sorted(by_place, key=lambda path: path.split("/"))


def test_duplicate_groups_and_ledger_rows_combine_before_shuffling(spark):
    groups = plan(accounting.content_duplicate_groups(fx.inventory(spark, SF)))
    # Counts aggregate in place; only contents that are repeated get their keeper looked for.
    assert "partial_min_by" in groups and "HashAggregate(keys=[hash" in groups
    rows = fx.ledger(spark, SF)
    first = plan(ledgers.first_per_hash(rows.withColumn("key", walk_key(F.col("src_path")))))
    assert "partial_min_by" in first


def test_the_shared_folder_is_the_configured_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert not named or shared_folder(spark) == named.rstrip("/")


class Unset:
    """A session without the setting, with a context that remembers its folder."""

    def __init__(self, master):
        self.conf, self.sparkContext, self.master, self.folder = self, self, master, None

    def get(self, key, default):
        return default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_without_a_shared_folder_only_a_local_session_makes_its_own():
    local = Unset("local[2]")
    assert shared_folder(local) == shared_folder(local) == local.folder
    with pytest.raises(ValueError):
        shared_folder(Unset("spark://host:7077"))
