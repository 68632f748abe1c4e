"""Mixing sources to target weights by capped water-filling.

``mix_sources`` shares a number of words among sources by weight. A source takes
``max_epochs`` times its own words at most; what it cannot take is shared anew
among the others by weight, until none is above its cap. Sorted by cap over
weight, the capped sources come first, so one running total over the (few)
sources gives the level at once, where sharing in rounds would repeat.

Documents are then sampled: each is taken whole as often as the target holds its
source, and the fraction that is left is filled in seeded hash order, the last
document in part, so a source's words come to its target rounded down. Hash
order is cut into buckets: totals per bucket settle all but the bucket in which
the fraction ends, and only the rows of that one are put in order. A source with
a third of all rows is thus 4,096 groups, and no group holds a whole source.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a null doc_id hashes as an empty one; repeated rows count each
for itself; an empty table gives no rows; other columns are not looked at. Of sources of
equal cap over weight the first by name is filled first, with the same targets. Very long
texts are counted whole. Rows without an id hash alike, so they share one bucket of their
source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.llm.common import scratch_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix"
# Hash order is cut by this many leading hex digits.
BUCKET_DIGITS = 3


def source_targets(
    sources: DataFrame, weights=WEIGHTS, share=SHARE, max_epochs=MAX_EPOCHS
) -> DataFrame:
    """``source, source_size`` with ``target`` in words; one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("_turn", (F.row_number().over(order) - 1) % len(weights)).withColumn(
        "_weight", F.element_at(F.array(*map(F.lit, weights)), F.col("_turn") + 1).cast("double")
    )
    every = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    filling = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        weighed.withColumn("_cap", F.col("source_size").cast("double") * max_epochs)
        .withColumn("_total", F.sum("source_size").over(every).cast("double") * share)
        .withColumn("_weights", F.sum("_weight").over(every))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(filling), F.lit(0.0)))
        .withColumn("_weight_before", F.coalesce(F.sum("_weight").over(filling), F.lit(0.0)))
        .withColumn(
            "_level",
            (F.col("_total") - F.col("_cap_before")) / (F.col("_weights") - F.col("_weight_before")),
        )
        # The level is that of the first source that is not capped; its place is null where it is.
        .withColumn(
            "_open",
            F.when(F.col("_level") * F.col("_weight") < F.col("_cap"), F.row_number().over(by_ratio)),
        )
        .withColumn("_water", F.min_by("_level", "_open").over(every))
    )
    target = F.coalesce(F.least("_cap", F.col("_water") * F.col("_weight")), F.col("_cap"))
    return level.select("source", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights=WEIGHTS,
    share=SHARE,
    max_epochs=MAX_EPOCHS,
    seed=SEED,
    scratch=None,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` per row of ``docs``."""
    scratch = scratch or scratch_of(docs)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = scratch.save(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            key.alias("_key"),
            F.substring(key, 1, BUCKET_DIGITS).alias("_bucket"),
            # Joins treat nulls as unequal; this stands for the source in them.
            F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_source"),
        ),
        "sizes",
    )
    buckets = sized.groupBy("source", "_source", "_bucket").agg(F.sum("size").alias("_words"))
    sources = buckets.groupBy("source", "_source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sources.drop("_source"), weights, share, max_epochs).withColumn(
        "_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        buckets.drop("source")
        .join(targets.drop("source"), "_source")
        .withColumn("_whole", whole.cast("long"))
        .withColumn("_cut", F.floor("target").cast("long") - F.col("_whole") * F.col("source_size"))
        .withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
        # What the fraction takes of the bucket.
        .withColumn("_part", F.greatest(F.lit(0), F.least("_words", F.col("_cut") - F.col("_before"))))
        .select("_source", "_bucket", "source_size", "target", "_whole", "_words", "_part")
    )
    rows = sized.join(plan, ["_source", "_bucket"])
    split = (F.col("_part") > 0) & (F.col("_part") < F.col("_words"))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, -1
    )
    done = F.coalesce(F.sum("size").over(inside), F.lit(0))
    cut = rows.where(split).withColumn(
        "_extra", F.greatest(F.lit(0), F.least("size", F.col("_part") - done))
    )
    rest = rows.where(~split).withColumn("_extra", F.when(F.col("_part") > 0, F.col("size")).otherwise(0))
    return cut.unionByName(rest).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long").alias("taken"),
    )
