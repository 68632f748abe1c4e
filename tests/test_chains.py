"""Chains ranked in parallel: equal to the loop, and no task holds one."""

import random

import pytest
from helpers import sequential_placement, values
from pyspark.sql import functions as F

from tidefold.functions import states
from tidefold.operators.chains import falling_distance, place_chains
from tidefold.operators.placement import greedy_placement
from tidefold.session import Scratch


def copied(rows):
    """Places of the rows that a walk copies; ``rows`` are (place, dest, hash)."""
    walked = sequential_placement([(f"/{place:09}", dest, digest) for place, dest, digest in rows])
    return {place for place, _, _ in rows if walked[f"/{place:09}"][0] == states.COPIED}


def place(spark, rows):
    edges = spark.createDataFrame(rows, "place bigint, dest_path string, hash string")
    return {p for (p,) in values(place_chains(edges, Scratch(spark)), "place")}


def path_of(size, order, name="", ring=False):
    """Rows whose destinations and contents link one to the next, at the places of ``order``."""
    def key(i):
        return i % size if ring else i
    return [(order[i], f"{name}d{key(i + 1) // 2 if not ring else (i + 1) % size // 2}", f"{name}h{i // 2}") for i in range(size)]


@pytest.mark.parametrize("seed", range(3))
def test_paths_rings_and_pairs_equal_the_loop(spark, seed):
    pick = random.Random(seed)
    places = list(range(1_000))
    pick.shuffle(places)
    rows, used = [], 0
    for turn, size in enumerate([1, 1, 2, 3, 8, 50, 120, 6, 40]):
        ring = turn > 6
        rows += path_of(size, places[used : used + size], f"{turn}-", ring)
        used += size
    # Two rows that share both.
    rows += [(places[used], "both", "both"), (places[used + 1], "both", "both")]
    assert place(spark, rows) == copied(rows)


def test_a_falling_path_takes_rounds_by_its_logarithm(spark):
    size, scratch = 100_000, Scratch(spark)
    pointers = spark.range(1, size).select(F.col("id").alias("place"), (F.col("id") - 1).alias("towards"))
    steps = falling_distance(pointers, spark.range(1).withColumnRenamed("id", "place"), scratch, "steps")
    assert steps.where("steps <> place").count() == 0 and steps.count() == size
    import os

    rounds = [name for name in os.listdir(scratch.path.removeprefix("file:")) if name.startswith("steps-")]
    assert len(rounds) <= 19


def test_a_long_chain_beside_a_knot_equals_the_loop(spark):
    """A chain of 60,000 rows; and one component with three rows at a key, which is walked."""
    size = 60_000
    rows = [(f"/{i:07}", f"d{(i + 1) // 2}", f"h{i // 2}") for i in range(size)]
    pick = random.Random(9)
    # Falling links between crowded keys need many rounds, too.
    knot = [(f"/x{i:05}", f"x{(i + 1) // 2}", f"x{i // 2}") for i in range(400)]
    knot += [(f"/y{i:03}", f"x{pick.randrange(190)}", f"x{pick.randrange(190)}") for i in range(20)]
    df = spark.createDataFrame(rows + knot, "path string, dest_path string, hash string")
    placed = greedy_placement(df, Scratch(spark), patience=2)
    got = {path: (s, e) for path, s, e in values(placed, "path", "state", "existing_path")}
    assert got == sequential_placement(rows + knot)


def test_nothing_to_place(spark):
    assert place(spark, []) == set()
