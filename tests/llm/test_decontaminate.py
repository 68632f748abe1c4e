import random
import re

from tidefold.llm.decontaminate import clean_documents, contained_items, size_class


def sets(text):
    words = re.findall(r"\w+", (text or "").lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(docs, items, least=0.8):
    return {
        (d, i): len(own & sets(text)) / len(own)
        for i, asked in items if (own := sets(asked))
        for d, text in docs if len(own & sets(text)) / len(own) >= least
    }


def found(df):
    return {(r["doc_id"], r["item_id"]): r["containment"] for r in df.collect()}


def test_equals_all_pairs(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r["doc_id"], r["text"]) for r in documents.collect()]
    items = [(r["item_id"], r["text"]) for r in benchmark.collect()]
    assert found(contained_items(documents, benchmark)) == expected(docs, items)


def test_items_of_all_sizes_in_long_documents(spark):
    random.seed(11)
    word = lambda: f"w{random.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(size))) for i, size in enumerate((6, 14, 20, 21, 40, 80, 300, 3000))]
    docs = []
    for d in range(40):
        words = [word() for _ in range(random.choice((50, 500, 8000)))]
        for _, text in random.sample(items, 3):
            own = text.split()
            for _ in range(random.choice((0, 0, len(own) // 60))):
                own[random.randrange(len(own))] = "changed"
            at = random.randrange(len(words))
            words[at:at] = own
        docs.append((d, " ".join(words)))
    want = expected(docs, items)
    assert len(want) > 60
    got = contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    assert found(got) == want


def test_hostile_rows(spark, hostile, no_docs):
    items = spark.createDataFrame(
        [(1, hostile.where("doc_id = 4").first()["text"]), (2, None), (3, ""), (4, "two words"), (5, "two words"), (None, "x y")],
        "item_id long, text string",
    ).selectExpr("*", "1 AS doc_id", "2 AS keys")
    # Equal items are named each.
    assert set(found(contained_items(hostile, items))) == {(4, 1), (5, 1), (6, 4), (6, 5)}
    kept = clean_documents(hostile, items)
    assert kept.columns == hostile.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 2, 3, 7, 8, 9, None, None], key=repr)
    assert contained_items(no_docs, items).count() == 0
    assert contained_items(hostile, items.limit(0)).count() == 0
    assert clean_documents(hostile, items.limit(0)).count() == hostile.count()


def test_classes_double():
    assert [size_class(n) for n in (1, 16, 17, 32, 33, 64, 65)] == [0, 0, 1, 1, 2, 2, 3]


def test_short_items_inside_long_documents(spark):
    random.seed(3)
    filler = lambda n: " ".join(f"f{random.randrange(900)}" for _ in range(n))
    items = [
        (1, "who wrote hamlet"), (2, "hamlet"), (3, "to be or not to be that is the question"), (None, "null id here"),
        (5, "who wrote hamlet"), (6, "four words in it"), (7, "one of five words"), (8, "never there at all"),
    ]
    docs = [(i, f"{filler(400)} {text} {filler(3_000)}") for i, (_, text) in enumerate(items[:7])]
    # One of ten words changed at the end leaves five of six shingles.
    docs.append((20, filler(300) + " to be or not to be that is the answer " + filler(300)))
    docs += [(21, "who wrote"), (22, "who  WROTE, Hamlet?"), (23, "hamlet wrote who"), (None, "a null id here too"), (24, filler(2_000))]
    got = contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    pairs = sorted(((r["doc_id"], r["item_id"]) for r in got.collect()), key=repr)
    hamlet = [(d, i) for d in (0, 4, 22) for i in (1, 2, 5)] + [(1, 2), (23, 2)]
    assert pairs == sorted([*hamlet, (2, 3), (20, 3), (3, None), (None, None), (5, 6), (6, 7)], key=repr)


def test_clean_documents_go_by_text(spark):
    rows = [(1, "some question of the test set here"), (1, "another text of that id"), (2, "some question of the test set here"),
            (None, "some question of the test set here"), (None, "clean and without an id")]
    items = spark.createDataFrame([(None, "some question of the test set here")], "item_id long, text string")
    kept = clean_documents(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], rows[4]], key=repr)
