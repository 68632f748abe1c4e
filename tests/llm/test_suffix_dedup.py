import hashlib
import random

import numpy as np
import pytest

from tidefold.llm import suffix_dedup as sd


def removed(rows):
    """Every window of 100 bytes, in a set."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            window = data[at : at + 100]
            if window in seen:
                gone[at : at + 100] = True
            seen.add(window)
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((tuple(r) for r in sd.remove_repeats(df).collect()), key=repr)


def test_suffix_order_is_right_for_its_span():
    rng = np.random.default_rng(1)
    for trial in range(400):
        codes = rng.integers(1, rng.integers(2, 5), rng.integers(1, 200))
        if trial % 3 == 0:
            codes = np.tile(codes[:7], 40)
        span = int(rng.integers(1, 60))
        order = sd.suffix_order(codes.astype(np.int64), span)
        assert sorted(order) == list(range(len(codes)))
        keys = [tuple(codes[i : i + span]) for i in order]
        assert keys == sorted(keys)


def crafted():
    random.seed(3)
    base = "".join(random.choices("abcd ", k=3000))
    texts = [
        "a" * 500, "ab" * 300, base, base[100:900] + "x" + base[300:1200], "a" * 130 + base[2000:2300], base, "", "z" * 99,
        "é" * 120, "xé" * 120 + "é" * 100, base[:50] * 9, base[2900:] + base[:400], None,
    ]
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("hot", [sd.HOT, 1])
def test_crafted_texts_equal_a_set_of_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    rows = crafted()
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == sorted(removed(rows), key=repr)


def test_documents_equal_a_set_of_windows(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert result(documents.repartition(6)) == sorted(removed(rows), key=repr)


def test_long_texts_are_cut_in_strides(spark, monkeypatch):
    monkeypatch.setattr(sd, "STRIDE", 700)
    rows = crafted()
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(removed(rows), key=repr)


def test_hostile_rows(hostile, no_docs):
    got = result(hostile)
    assert len(got) == hostile.count()
    # The long text repeats itself; the rows of one id and text keep one.
    assert [r[2] for r in got if r[0] in (4, 5)] == [0, 0, 0]
    assert next(r for r in got if r[0] == 9)[1:4] == (300_000, 299_999, 1)
    assert result(no_docs) == []


def test_rows_that_repeat_id_and_text_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(100))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, text + "q"), (2, None)], "doc_id long, text string")
    got = result(df)
    n = len(text)
    assert sorted(r[2] for r in got) == sorted([0, n, n, n, 0])
