"""How many contents, and of how many bytes, without counting one twice.

A bottom-k sketch keeps, of all different contents, the ``k`` whose hashes have the least
values, with their sizes. Values are uniform whatever the contents, so these are a random
sample without repeats: of n contents it holds the share ``theta`` = the k-th value over all
values. Sketches of parts merge to that of the whole (the k least of both), so a run's
sketch and those of earlier runs add up without reading anything again.

Totals come out with a standard error. For contents it is about 1 / sqrt(k - 2) of the
total (2.2 % at 2,048); for bytes it is measured from the sizes in the sketch, and is
larger where few contents hold most bytes.

Building it moves a sample only: values beyond a threshold at which ``MARGIN`` times k rows
are expected to be left are dropped where they are read. Were the rows that are left few
different contents, the threshold is raised until there are k, or all are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 2_048
MARGIN = 4
# Values are whole numbers below this.
VALUES = 1 << 60


def value(digest: Column) -> Column:
    """A uniform number of a content: 15 hex digits of the MD5 of its digest."""
    return F.conv(F.substring(F.md5(digest), 1, 15), 16, 10).cast("bigint")


def _least(rows: DataFrame, k: int) -> DataFrame:
    """The k least values, once each; a task sends k at most."""
    once = rows.groupBy("value").agg(F.min("size").alias("size"))
    return once.orderBy("value").limit(k)


def sketch(rows: DataFrame, k: int = K) -> DataFrame:
    """``value, size``: the sketch of the contents of ``rows`` (hash, size); rows without a hash do not count."""
    known = rows.where(F.col("hash").isNotNull())
    valued = known.select(value(F.col("hash")).alias("value"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    total = known.count()
    share = MARGIN * k
    while share < total:
        below = valued.where(F.col("value") < VALUES // total * share)
        if below.agg(F.approx_count_distinct("value", 0.02)).first()[0] > 1.2 * k:
            return _least(below, k)
        # Few contents come many times: a larger part of the values is needed.
        share *= 8
    return _least(valued, k)


def merge(one: DataFrame, other: DataFrame, k: int = K) -> DataFrame:
    """The sketch of both; each holds ``k`` at most."""
    return _least(one.unionByName(other), k)


def totals(sketched: DataFrame, k: int = K) -> DataFrame:
    """One row: ``contents, bytes`` and their standard errors, 0 where the sketch holds every content."""
    seen = sketched.agg(
        F.count(F.lit(1)).alias("rows"),
        F.max("value").alias("last"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("all_bytes"),
        F.coalesce(F.max_by("size", "value"), F.lit(0)).alias("last_bytes"),
        F.coalesce(F.sum(F.col("size").cast("double") * F.col("size")), F.lit(0.0)).alias("squares"),
    )
    whole = F.col("rows") < k
    theta = F.col("last") / F.lit(float(VALUES))
    # The k-th value sets the scale; it is no part of the sample.
    contents = F.when(whole, F.col("rows")).otherwise((F.col("rows") - 1) / theta)
    held = F.when(whole, F.col("all_bytes")).otherwise((F.col("all_bytes") - F.col("last_bytes")) / theta)
    spread = F.sqrt((1 - theta) * (F.col("squares") - F.col("last_bytes").cast("double") * F.col("last_bytes"))) / theta
    return seen.select(
        F.floor(contents).cast("bigint").alias("contents"),
        F.floor(held).cast("bigint").alias("bytes"),
        F.when(whole, 0.0).otherwise(contents / F.sqrt(F.lit(float(max(k - 2, 1))))).alias("contents_error"),
        F.when(whole, 0.0).otherwise(spread).alias("bytes_error"),
    )
