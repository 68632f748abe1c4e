import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tidefold.llm import near_dedup as nd
from tidefold.llm.shingles import shingle_codes, split, word_codes


def shingle_sets(texts):
    found = []
    for text in texts:
        words = re.findall(r"\w+", (text or "").lower())
        found.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    return found


def classes(texts):
    """Components of texts that are equal or similar to 0.8, by all pairs."""
    sets, parent = shingle_sets(texts), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holds = defaultdict(list)
    for i, own in enumerate(sets):
        for s in own:
            holds[s].append(i)
    pairs = {(a, b) for own in holds.values() for k, a in enumerate(own) for b in own[k + 1 :]}
    pairs |= {(a, b) for a in range(len(texts)) for b in range(a) if (texts[a] or "") == (texts[b] or "")}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if (texts[a] or "") == (texts[b] or "") or both / len(sets[a] | sets[b]) >= 0.8:
            parent[find(a)] = find(b)
    return [find(i) for i in range(len(texts))]


def named(ids, labels):
    least = {}
    for i, label in zip(ids, labels):
        least[label] = min(i, least.get(label, i))
    return {i: least[label] for i, label in zip(ids, labels)}


def test_words_are_those_of_the_pattern():
    texts = ["Àé Ñandú ß_x 1a", "", None, "a b", "naïve ×÷ x", "日本 語 X", "É b", "Ωm µ ª A", "été ÉTÉ", "x" * 2_000_000 + " y"]
    codes, places = word_codes(pa.array(texts))
    assert np.diff(places).tolist() == [len(re.findall(r"\w+", (t or "").lower())) for t in texts]
    words = [w for t in texts for w in re.findall(r"\w+", (t or "").lower())]
    assert len(set(zip(words, codes.tolist()))) == len(set(words)) == len(set(codes.tolist()))


def test_estimates_the_probability_jaccard():
    rng = np.random.default_rng(2)
    a, b = rng.integers(1, 2**63, 300).astype(np.uint64), None
    b = np.concatenate([a[:220], rng.integers(1, 2**63, 60).astype(np.uint64)])
    wa, wb = rng.uniform(1, 3, len(a)), rng.uniform(1, 3, len(b))
    wb[:220] = wa[:220]
    x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    exact = sum(
        1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in set(x) | set(y)) for d in set(x) & set(y)
    )
    got = (nd.prob_minhash(a, wa, 4096) == nd.prob_minhash(b, wb, 4096)).mean()
    assert abs(got - exact) < 4 * (exact * (1 - exact) / 4096) ** 0.5


def test_classes_equal_all_pairs(spark):
    random.seed(7)
    base = [" ".join(random.choices([f"w{i}" for i in range(400)], k=150)) for _ in range(30)]
    texts = []
    for text in base:
        texts.append(text)
        for _ in range(random.randint(0, 12)):
            words = text.split()
            for _ in range(random.randint(0, 5)):
                words[random.randrange(len(words))] = f"z{random.random()}"
            text = " ".join(words)
            texts.append(text)
    texts += texts[:9] + ["", None, "", "short one", "short one", "Short, one!"]
    rows = [(1000 - i, t) for i, t in enumerate(texts)]
    got = nd.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = named([i for i, _ in rows], classes(texts))
    found = {r["doc_id"]: r["class_id"] for r in got}
    # Texts under five words are one shingle of what they have.
    assert found == want


def test_hostile_rows(hostile, no_docs):
    got = nd.near_classes(hostile).collect()
    assert len(got) == hostile.count()
    of = defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(r["class_id"])
    assert of[4] == [4] and of[5] == [4, 4] and of[1] == of[2] == [1] and set(of[None]) == {None, 1}
    kept = nd.one_of_each(hostile)
    assert kept.columns == hostile.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 3, 4, 6, 7, 8, 9, None, None], key=repr)
    assert nd.near_classes(no_docs).count() == 0 and nd.one_of_each(no_docs).count() == 0


def test_members_outside_the_largest_part_are_compared(spark):
    # One hub alone would miss the link between the second and third text.
    shared = [f"s{i}" for i in range(60)]
    texts = [" ".join(shared + [f"{tag}{i}" for i in range(40)]) for tag in "ab"]
    texts.append(texts[1].replace("b7 ", "c7 "))
    got = nd.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {0: 0, 1: 1, 2: 1}
    assert all(len(s) for s in split(*shingle_codes(pa.array(texts))))


def test_classes_and_rows_where_ids_repeat(spark):
    random.seed(5)
    text = lambda: " ".join(random.choices([f"w{i}" for i in range(400)], k=120))
    a, other, third = text(), text(), text()
    near = a.rsplit(" ", 1)[0] + " changed"
    rows = [(3, a), (5, near), (5, other), (5, third), (5, third), (7, other + " more"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id + 1 AS own_digest", "'x' AS own_times")
    got = nd.near_classes(df).collect()
    assert len(got) == len(rows)
    labels = {}
    for r in got:
        labels.setdefault((r["class_id"], r["class_digest"]), []).append(r["doc_id"])
    assert sorted(sorted(map(str, ids)) for ids in labels.values()) == [["3", "5", "None"], ["5", "5"], ["5", "7"]]
    kept = nd.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(
        [(3, a), (5, other), (5, third), (None, a)], key=repr
    )


def test_verification_is_the_same_in_buckets_of_two(spark):
    """Texts whose repeated shingles weigh much: the plain Jaccard alone decides."""
    rng = random.Random(8)
    texts = []
    for i in range(40):
        words = [f"{i}x{j}" for j in range(60)]
        often = words[:6] * 60
        texts += [" ".join(words + often), " ".join([*words[:-1], "end", *(w for w in words[:6] for _ in range(rng.randrange(1, 3)))])]
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = named(list(range(len(texts))), classes(texts))
    linked = sum(want[i] != i for i in want)
    assert all(got[i] in (i, want[i]) for i in want)
    assert sum(got[i] != i for i in got) >= 0.9 * linked
