import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidefold.llm import periodic_runs as module
from tidefold.llm.grammar import Grammar
from tidefold.llm.periodic_runs import periodic_runs, text_runs
from tidefold.llm.registry import op13_periodic_runs, with_repeats


def smallest_period(words):
    return next(q for q in range(1, len(words) + 1) if words[q:] == words[: len(words) - q])


def brute_runs(words, least=6, times=4):
    """Every stretch that agrees at distance q and cannot grow, kept where q is its smallest period."""
    found = []
    for q in range(1, len(words) // times + 1):
        place = 0
        while place + q < len(words):
            end = place
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            length = end + q - place
            if length >= max(least, times * q) and smallest_period(words[place : end + q]) == q:
                found.append((place, length, q))
            place = end + 1
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def edited(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def periodic_words(rng, size, letters):
    words = [rng.randrange(letters) for _ in range(size)]
    if size and rng.random() < 0.7:
        a = rng.randrange(size)
        p = rng.randint(1, max(1, (size - a) // 3))
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return list(map(str, words))


@pytest.mark.parametrize("roots", [1, 8, 64])
def test_extensions_equal_a_loop(roots):
    rng = random.Random(roots)
    for _ in range(40):
        words = list(map(int, periodic_words(rng, rng.randint(1, 60), rng.choice([1, 2, 4]))))
        text = np.array([90, *words, 91, *words[: len(words) // 2], 92])
        grammar = Grammar(text, roots)
        x, y = np.array([(i, j) for i in range(1, len(text) - 1) for j in range(i + 1, len(text))]).T
        for i, j, ahead, behind in zip(x, y, grammar.common_ahead(x, y), grammar.common_behind(x, y)):
            n = next(k for k in range(len(text)) if j + k == len(text) or text[i + k] != text[j + k])
            m = next(k for k in range(len(text)) if text[i - 1 - k] != text[j - 1 - k])
            assert (ahead, behind) == (n, m)


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (9, 3)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least)
    for _ in range(60):
        docs = [periodic_words(rng, rng.randint(0, 100), rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(1, 4))]
        for words, (size, runs, left) in zip(docs, text_runs([" ".join(w).encode() for w in docs], least, times)):
            want = brute_runs(words, least, times)
            assert (size, list(map(tuple, runs.tolist()))) == (len(words), want)
            assert left.decode() == collapsed(words, want)


def test_small_batches_of_points_and_blocks(spark, documents, monkeypatch):
    rng = random.Random(3)
    words = periodic_words(rng, 400, 2)
    whole = list(text_runs([" ".join(words).encode()]))[0][1].tolist()
    monkeypatch.setattr(module, "MOST_POINTS", 7)
    assert list(text_runs([" ".join(words).encode()]))[0][1].tolist() == whole


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = {r["doc_id"]: r for r in op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(docs)
    for doc in docs:
        words = edited(doc["doc_id"], doc["text"])
        if len(words) > 1_200:
            continue
        runs, row = brute_runs(words), rows[doc["doc_id"]]
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        assert row["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert row["collapsed_sha256"] == sha(collapsed(words, runs))
    assert sum(r["n_runs"] > 0 for r in rows.values()) > 5


def test_edit_of_long_texts(hostile):
    words = lambda text: re.findall(r"[^\x20\x09-\x0D]+", text or "")
    got = sorted(((r["doc_id"], words(r["text"])) for r in with_repeats(hostile).collect()), key=repr)
    assert got == sorted(((d["doc_id"], edited(d["doc_id"], d["text"])) for d in hostile.collect()), key=repr)


def test_hostile_rows(spark, hostile, no_docs):
    repeated = spark.createDataFrame([(50, "a " * 30_000), (51, "x y z " * 9 + "x"), (None, " \n\t ")], "doc_id long, text string")
    table = hostile.select("doc_id", "text").unionByName(repeated)
    got = sorted(((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in periodic_runs(table).collect()), key=repr)
    want = []
    for doc in table.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", doc["text"] or "")
        # The long texts are one run each: the words of the first come again after 2 * 977 * 13.
        known = {3: [(0, 120_000, 25_402)], 50: [(0, 30_000, 1)]}
        runs = known.get(doc["doc_id"]) or brute_runs(words)
        want.append((doc["doc_id"], len(words), tuple(runs), collapsed(words, runs)))
    assert got == sorted(want, key=repr)
    assert periodic_runs(hostile).count() == hostile.count()
    assert periodic_runs(no_docs).count() == 0
