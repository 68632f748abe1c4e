import itertools
import math

import numpy as np

from tidefold.llm import language_id as lid


def segmentations(word):
    for cuts in itertools.product((False, True), repeat=len(word) - 1):
        at = [0, *(i + 1 for i, cut in enumerate(cuts) if cut), len(word)]
        yield [word[a:b] for a, b in zip(at, at[1:])]


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "abb"]
    probs = np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 2).T
    model = lid.PieceModel(pieces, ["x", "y"], probs)
    words = ["a", "ab", "abba", "babb", "cab", "abcab"]
    names, logs = model.scores(words)
    for word, row in zip(names, logs):
        for lang in range(2):
            total = 0.0
            for parts in segmentations("▁" + word):
                own = [
                    max(probs[pieces.index(p)][lang] if p in pieces else 0, lid.UNKNOWN if len(p) == 1 else 0)
                    for p in parts
                ]
                total += math.prod(own)
            assert math.isclose(math.log(total), row[lang], rel_tol=1e-9)


def test_expected_uses_sum_to_pieces_per_word():
    model = lid.PieceModel(["▁", "a", "▁a", "aa"], ["x"], np.array([[0.2], [0.3], [0.4], [0.1]]))
    uses = model.expected({"a": np.array([2.0])})
    both, one = 0.2 * 0.3, 0.4
    share = both / (both + one)
    assert np.allclose(uses[:, 0], [2 * share, 2 * share, 2 * (1 - share), 0])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = lid.identify(docs, lid.learn(docs)).where(lid.held_out()).collect()
    assert len(judged) > 150
    assert sum(r["lang"] == r["lang_pred"] for r in judged) / len(judged) > 0.97


def test_hostile_rows(spark, documents, hostile, no_docs):
    model = lid.learn(documents)
    rows = lid.identify(hostile, model).collect()
    assert len(rows) == hostile.count()
    for r in rows:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == lid.UNDETERMINED) == (not letters)
        assert (r["score"] == 0) if not letters else (0 < r["score"] <= 1)
        assert r["node"] == "clash"
    assert lid.identify(no_docs, model).count() == 0
    assert lid.learn(no_docs) is None
    assert {r["lang_pred"] for r in lid.identify(hostile, None).collect()} == {"und"}
    assert lid.learn(hostile) is not None


def test_labels_of_held_out_rows_are_not_read(spark, documents):
    from pyspark.sql import functions as F

    wrong = documents.withColumn("lang", F.when(lid.held_out(), "zz").otherwise(F.col("lang")))
    a, b = lid.learn(documents), lid.learn(wrong)
    assert a.langs == b.langs and a.pieces == b.pieces and np.array_equal(a.probs, b.probs)
