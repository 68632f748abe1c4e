import hashlib

from tidefold.llm.fingerprints import BITS, SimHash, fingerprint_edits, likeness, within_radius
from tidefold.llm.registry import op5_fingerprints


def expected(rows):
    simhash = SimHash()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    found = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text)
        edited = text[: n - n // 3] + after[: n // 3]
        a, b, c = simhash(text), simhash(edited), simhash(after)
        found.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), likeness(a, b), likeness(a, c)))
    return sorted(found, key=repr)


def test_equals_a_loop(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = sorted(map(tuple, fingerprint_edits(documents.repartition(5)).collect()), key=repr)
    assert got == expected(rows)


def test_hostile_rows(spark, hostile, no_docs):
    rows = [tuple(r) for r in hostile.select("doc_id", "text").collect()]
    assert sorted(map(tuple, fingerprint_edits(hostile).collect()), key=repr) == expected(rows)
    assert fingerprint_edits(no_docs).count() == 0
    assert fingerprint_edits(hostile.where("doc_id = 6")).first()["near_next"] == 1.0


def test_radius_equals_all_pairs(spark, documents):
    prints = [r["fingerprint"] for r in fingerprint_edits(documents).collect()]
    # Near ones of all distances, since random texts are far apart.
    flipped = [f"{int(p, 16) ^ (1 << 5 * i | 1 << 9 | (i % 3) << 60):0{BITS // 4}x}" for i, p in enumerate(prints[:20])]
    every = spark.createDataFrame([(p,) for p in prints + flipped + flipped[:3]], "fingerprint string")
    got = {(r["query"], r["fingerprint"]): (r["rows"], r["distance"]) for r in within_radius(every, every).collect()}
    texts = prints + flipped + flipped[:3]
    want = {}
    for a in set(texts):
        for b in set(texts):
            distance = (int(a, 16) ^ int(b, 16)).bit_count()
            if distance <= 3:
                want[a, b] = (texts.count(b), distance)
    assert got == want


def test_the_query_has_a_row_per_row_where_ids_repeat(spark, tmp_path):
    rows = [(100, "a text of some words"), (100, "another text of other words"), (100, "another text of other words"), (7, "x"), (200, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    near = {(r["doc_id"], r["fingerprint"]): r["rows_near"] for r in got}
    assert sorted((i, n) for (i, _), n in near.items() if n is not None) == [(100, 1), (100, 2), (200, 1)]
