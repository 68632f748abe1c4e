from itertools import permutations

from tidefold.llm.filter_audit import audit_filters

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failing(doc, docs):
    text = doc["text"] or ""
    words = text.encode().split()
    upper = sum("A" <= c <= "Z" for c in text)
    earlier = any(
        o["doc_id"] is not None and doc["doc_id"] is not None and o["doc_id"] < doc["doc_id"] and (o["text"] or "") == text
        for o in docs
    )
    tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * upper > 10 * len(text),
             any(c in "#$%&*|" for c in text), earlier)
    return {name for name, fails in zip("ABCDE", tests) if fails}


def replayed(docs, labels):
    """Each order run filter by filter over the documents themselves."""
    flag = lambda c: {row["doc_id"] for row in labels if row[c] == 1 and row["doc_id"] is not None}
    good, toxic = flag("quality"), flag("toxic")
    parts = {}
    for doc in docs:
        parts.setdefault(doc["lang"] or "", []).append((doc["doc_id"], failing(doc, docs)))
    out = {}
    for part, rows in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in rows) - len(gone), sum(f == {name} for _, f in rows),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {key: tuple(row) for key, row in out.items()}


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[f] for f in FIELDS) for r in df.collect()}


def test_hostile_rows(spark, hostile, no_docs):
    labels = spark.createDataFrame(
        [(3, 1, 0), (4, 1, 1), (5, 0, 1), (5, 1, None), (None, 1, 1), (99, 1, 1), (7, None, None)],
        "doc_id long, quality int, toxic int",
    )
    assert got(audit_filters(hostile, labels)) == replayed(hostile.collect(), labels.collect())
    assert got(audit_filters(hostile, labels.limit(0))) == replayed(hostile.collect(), [])
    assert audit_filters(no_docs, labels).count() == 0


def test_equals_a_replay(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert got(audit_filters(documents, labels)) == replayed(documents.collect(), labels.collect())


def test_copies_are_judged_by_the_whole_table(spark):
    docs = spark.createDataFrame(
        [(2, "x", "en"), (1, "x", "de"), (1, "x", "de"), (3, None, "en"), (4, "", "en"), (None, "x", "en")],
        "doc_id long, text string, lang string",
    )
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = got(audit_filters(docs, labels))
    assert rows["de", "EABCD", 1][:2] == (2, 0)
    assert rows["en", "EABCD", 1][:2] == (2, 2)
    assert rows == replayed(docs.collect(), [])
