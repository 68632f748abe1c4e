import os
import random

import pytest
from helpers import sequential_placement, sf, values
from pyspark.sql import functions as F

from tidefold.functions import states
from tidefold.operators import lookups
from tidefold.operators.placement import greedy_placement
from tidefold.operators.skew import HotKeys, balanced_join, measure_hot_keys
from tidefold.session import Scratch
from tidefold.verify import fixtures as fx
from tidefold.verify import registry


def place(spark, rows, **options):
    df = spark.createDataFrame(rows, "path string, dest_path string, hash string")
    scratch = Scratch(spark)
    placed = greedy_placement(df, scratch, **options)
    return {path: (s, e) for path, s, e in values(placed, "path", "state", "existing_path")}


def test_a_row_freed_by_a_duplicate_is_copied(spark):
    rows = [("/1", "d1", "h1"), ("/2", "d2", "h1"), ("/3", "d2", "h3")]
    assert place(spark, rows) == {
        "/1": (states.COPIED, None), "/2": (states.DUPLICATE, "d1"), "/3": (states.COPIED, None),
    }


def test_same_name_and_content_counts_as_destination(spark):
    rows = [("/1", "d1", "h1"), ("/2", "d1", "h1")]
    assert place(spark, rows)["/2"] == (states.SKIPPED_DEST_EXISTS, None)


def test_chain(spark):
    rows = [(f"/{i:02}", f"d{(i + 1) // 2}", f"h{i // 2}") for i in range(12)]
    assert place(spark, rows) == sequential_placement(rows)


def rotated(days):
    """Each day every file moves on by one number and a new one comes first."""
    return [
        (f"/day{day:03}/{number:03}", f"d{number}", f"h{day - number}")
        for day in range(days) for number in range(day + 1)
    ]


@pytest.mark.parametrize("patience", [2, 100])
def test_rotation_in_rounds_and_walked_at_the_end(spark, patience):
    rows = rotated(10)
    assert place(spark, rows, patience=patience) == sequential_placement(rows)


def test_no_rows(spark):
    assert place(spark, []) == {}


@pytest.mark.parametrize("seed, keys", [(1, 8), (2, 40), (3, 200)])
def test_equals_the_sequential_loop(spark, seed, keys):
    pick = random.Random(seed)
    folders = ["a", "a-b", "a.b", "b"]
    rows = [
        (f"/{pick.choice(folders)}/{i}", f"d{pick.randrange(keys)}", f"h{pick.randrange(keys)}")
        for i in range(300)
    ]
    assert place(spark, rows) == sequential_placement(rows)


def test_hot_keys_are_split_without_changing_the_result(spark):
    pick = random.Random(4)
    rows = []
    for i in range(600):
        dest = "hot" if i % 3 == 0 else f"d{pick.randrange(300)}"
        digest = "hot" if i % 3 == 1 else f"h{pick.randrange(300)}"
        rows.append((f"/x/{i}", dest, digest))
    assert place(spark, rows, hot_rows=50) == sequential_placement(rows)


def test_result_does_not_depend_on_partitions(spark):
    pick = random.Random(5)
    rows = [(f"/{i}", f"d{pick.randrange(60)}", f"h{pick.randrange(60)}") for i in range(200)]
    df = spark.createDataFrame(rows, "path string, dest_path string, hash string")
    outcomes = []
    for parts in (1, 7):
        placed = greedy_placement(df.repartition(parts), Scratch(spark))
        outcomes.append(sorted(values(placed, "path", "state", "existing_path"), key=str))
    assert outcomes[0] == outcomes[1]


def test_measured_hot_keys_are_exact_and_bounded(spark):
    df = spark.range(1_000).select(
        F.when(F.col("id") < 400, "a").when(F.col("id") < 700, "b").otherwise(
            F.col("id").cast("string")).alias("k")
    )
    hot = measure_hot_keys(df, "k", 1_000, hot_rows=10)
    assert hot.values == ("a", "b") and hot.salts >= 2
    assert measure_hot_keys(df, "k", 1_000) == HotKeys("k")


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_balanced_join_equals_the_plain_join(spark, how):
    left = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None))
        .otherwise((F.col("id") % 50).cast("string")).alias("k"), "id",
    )
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("2", 3), ("77", 4)], "k string, v int")
    plain = left.join(right, "k", how)
    split = balanced_join(left, right, how, HotKeys("k", ("hot", "absent"), 5), "id")
    assert sorted(map(str, plain.collect())) == sorted(map(str, split.select(*plain.columns).collect()))


def test_lookups_split_on_measured_keys_find_the_same_rows(spark):
    rows, known = registry.keyed_inventory(spark, sf("0.001")), fx.ledger(spark, sf("0.001"))
    listed = fx.dest_listing(known)
    by_hash = measure_hot_keys(rows, "hash", hot_rows=1)
    # No destination outweighs a partition here; any key may be split.
    by_dest = HotKeys("dest_path", tuple(d for (d,) in values(listed, "dest_path")), 3)
    for lookup, args, hot in (
        (lookups.ledger_duplicates, (known,), (by_hash,)),
        (lookups.insert_or_ignore, (known,), (by_hash,)),
        (lookups.dest_exists, (listed,), (by_dest,)),
        (lookups.new_content, (known, listed), (by_hash, by_dest)),
    ):
        plain = sorted(values(lookup(rows, *args), "path"))
        assert plain and plain == sorted(values(lookup(rows, *args, *hot), "path"))


def test_published_counts_with_mtime_months(spark):
    """Final states of the fixture with the month taken from mtime."""
    run = fx.run(spark, sf("0.01"))
    run.inventory = fx.inventory(spark, sf("0.01"))
    run.tags = run.tags.limit(0)
    got = dict(values(run.results().groupBy("state").count(), "state", "count"))
    assert got == {
        "copied": 540, "duplicate (hash exists)": 35, "skipped (destination exists)": 141,
        "skipped (extension)": 166, "skipped (incremental)": 118,
    }


def test_hot_splits_leave_a_whole_run_unchanged(spark):
    from tidefold.plans.ingest import classify_run

    run = fx.run(spark, sf("0.001"))
    split = classify_run(run, run.mark, fx.DEST, Scratch(spark), hot_rows=1)
    plain = registry.final_results(spark, sf("0.001"))
    assert sorted(map(str, split.select(*plain.columns).collect())) == sorted(
        map(str, plain.collect())
    )


def test_scratch_tables_can_be_dropped(spark):
    scratch = Scratch(spark)
    scratch.save(spark.range(3), "three")
    assert os.path.isdir(scratch.path)
    scratch.drop()
    assert not os.path.exists(scratch.path)


def chain(rows):
    return [(f"/{i:07}", f"d{(i + 1) // 2}", f"h{i // 2}") for i in range(rows)]


def test_long_chains_take_a_bounded_number_of_rounds(spark):
    rows = chain(3_000) + [(f"/x{path}", f"x{d}", f"x{h}") for path, d, h in chain(500)]
    df = spark.createDataFrame(rows, "path string, dest_path string, hash string")
    scratch = Scratch(spark)
    placed = greedy_placement(df, scratch, patience=2)
    got = {path: (s, e) for path, s, e in values(placed, "path", "state", "existing_path")}
    assert got == sequential_placement(rows)
    tables = os.listdir(scratch.path.removeprefix("file:"))
    assert sum(name.startswith("won-") for name in tables) == 3
    assert sum(name.startswith("components-large-") for name in tables) <= 20


def test_rows_without_a_key_get_a_state(spark):
    rows = [("/1", "d1", None), ("/2", None, "h1"), ("/3", "d1", "h1"), ("/4", None, None)]
    assert place(spark, rows) == {
        "/1": (states.ERROR_HASH, None), "/2": (states.SKIPPED_NO_DATE, None),
        "/3": (states.COPIED, None), "/4": (states.SKIPPED_NO_DATE, None),
    }
