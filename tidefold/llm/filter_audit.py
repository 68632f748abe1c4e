"""How filters overlap: what each removes, and would have removed, in every order.

``judge`` tells per document which filters it fails. ``failure_counts`` counts
documents per part, failure pattern and label; copies of one text are combined
before anything of theirs meets, so a text that a third of all rows share is a few
rows. ``audit`` reshapes a part's counts to a tensor with one axis of two cells
(passes, fails) per filter. A step of an order is then a vector per axis: *passes*
for the filters before it, *fails* for its own, *all* for those after it; one
``einsum`` per part contracts the tensor with the vectors of all steps of all
orders. Whatever the corpus, a part is 2^k cells here.

Defined results: a null text is empty; a null part is the empty string, and one
part with it. A document is a copy if a row of smaller doc_id has its text, so
rows of equal id are no copies of each other, and a row without an id neither is
nor makes a copy. A row without an id has no labels; where ``labels`` repeats an
id, one row with the flag is enough. Repeated rows count each for itself. An empty
table gives no rows. Other columns are not looked at. Whole texts are judged,
however long.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
LEAST_WORDS = 100
DISTINCT_PCT = 80
UPPER_PCT = 10
MARKS = "[#$%&*|]"
COPY = "E"

STEP = "part string, filter_order string, step int, kept long, removed long, redundant long, " \
    "unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_filters() -> dict[str, Column]:
    """Failure conditions over ``_text`` and its words ``_words``, by letter."""
    words = F.size("_words")
    return {
        "A": words < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct("_words")) < DISTINCT_PCT * words,
        "C": 100 * F.regexp_count("_text", F.lit("[A-Z]")) > UPPER_PCT * F.length("_text"),
        "D": F.col("_text").rlike(MARKS),
    }


def judge(docs: DataFrame, part: str = "lang", filters: Mapping[str, Column] | None = None) -> DataFrame:
    """``doc_id, part, digest, fails`` per row; bit i of ``fails`` is set where filter i fails."""
    filters = text_filters() if filters is None else filters
    text = docs.select(
        "doc_id",
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("_text"),
    ).withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    bits = sum((F.when(failing, 1 << i).otherwise(0) for i, failing in enumerate(filters.values())), F.lit(0))
    return text.select("doc_id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), bits.alias("fails"))


def with_labels(judged: DataFrame, labels: DataFrame) -> DataFrame:
    """``good`` and ``toxic`` per row, false where nothing is known."""
    flags = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    )
    known = judged.where(F.col("doc_id").isNotNull()).join(flags, "doc_id", "left")
    # Rows without an id would all meet in one task of the join.
    unknown = judged.where(F.col("doc_id").isNull()).withColumns({"good": F.lit(False), "toxic": F.lit(False)})
    return known.unionByName(unknown).na.fill(False, ["good", "toxic"])


def failure_counts(judged: DataFrame) -> DataFrame:
    """``part, fails, good, toxic`` with ``originals`` and ``copies``, the documents that pass and fail the copy test."""
    kind = ["digest", "part", "fails", "good", "toxic"]
    by_id = judged.groupBy(*kind, "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    has_id = F.col("doc_id").isNotNull()
    by_text = by_id.groupBy(*kind).agg(
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum(F.when(~has_id, F.col("rows"))), F.lit(0)).alias("nameless"),
        F.min(F.when(has_id, F.struct("doc_id", "rows"))).alias("least"),
    )
    # Of a text, a row per part, pattern and label is left.
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    kept = F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.rows")).otherwise(0)
    return (
        by_text.withColumn("originals", kept)
        .groupBy("part", "fails", "good", "toxic")
        .agg(F.sum("originals").alias("originals"), F.sum(F.col("rows") - F.col("originals")).alias("copies"))
    )


def contract(tensors: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Sums of each tensor ``(t, 2, 2, ...)`` under each row of ``picks`` ``(n, axes, 2)``: ``(t, n)``."""
    axes = picks.shape[1]
    operands = [tensors, [axes + 1, *range(axes)]]
    for axis in range(axes):
        operands += [picks[:, axis], [axes, axis]]
    return np.einsum(*operands, [axes + 1, axes], optimize=True)


PASSES, FAILS, ALL = (1, 0), (0, 1), (1, 1)


def step_table(part: str, tensors: np.ndarray, names: str) -> pd.DataFrame:
    """Every step of every order for the tensors of all, good and toxic documents."""
    axes = len(names)
    orders = list(permutations(range(axes)))
    steps = [(order, k) for order in orders for k in range(axes)]

    def picks(before, own, after):
        return np.array(
            [[before if a in order[:k] else own if a == order[k] else after for a in range(axes)] for order, k in steps],
            np.int64,
        )

    removed, good, toxic = contract(tensors, picks(PASSES, FAILS, ALL))
    kept = contract(tensors[:1], picks(PASSES, PASSES, ALL))[0]
    failing = contract(tensors[:1], picks(ALL, FAILS, ALL))[0]
    alone = contract(tensors[:1], picks(PASSES, FAILS, PASSES))[0]
    own = np.array([order[k] for order, k in steps])
    shares = np.zeros(axes, np.int64)
    np.add.at(shares, own, removed)
    return pd.DataFrame({
        "part": part,
        "filter_order": ["".join(names[a] for a in order) for order, _ in steps],
        "step": np.array([k + 1 for _, k in steps], np.int32),
        "kept": kept, "removed": removed, "redundant": failing - removed, "unique_fails": alone,
        "good_lost": good, "toxic_lost": toxic, "shapley": shares[own],
    })


def audit(counts: DataFrame, names: str) -> DataFrame:
    """A row per part, order of ``names`` and step; the last name is the copy test."""
    axes = len(names)

    def steps(rows: pd.DataFrame) -> pd.DataFrame:
        tensors = np.zeros((3, *[2] * axes), np.int64)
        for row in rows.itertuples():
            cell = tuple(row.fails >> a & 1 for a in range(axes - 1))
            for tensor, counted in zip(tensors, (True, row.good, row.toxic)):
                if counted:
                    tensor[cell] += (row.originals, row.copies)
        return step_table(rows["part"].iloc[0], tensors, names)

    # A part has 2^(k+1) rows here at most.
    return counts.groupBy("part").applyInPandas(steps, STEP)


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The audit of the five text filters over ``docs``."""
    filters = text_filters()
    judged = with_labels(judge(docs, part, filters), labels)
    return audit(failure_counts(judged), "".join(filters) + COPY)
