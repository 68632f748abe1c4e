"""Small tables for the operators: hostile rows, empty tables, clashing names."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
SAME = "the same words come here again and again so that two rows are equal in every way"
# Names that the operators use inside, or return.
CLASHES = ("node", "key", "score", "lang_pred", "_shard", "turn", "id", "digest", "size", "taken", "_key")


@pytest.fixture(scope="session")
def hostile(spark):
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, LONG, "en", "a", len(LONG)),
        (4, SAME, "en", "b", len(SAME)),
        (5, SAME, None, "b", len(SAME)),
        (5, SAME, None, "b", len(SAME)),
        (6, "two words", "de", "b", 9),
        (7, "12 34 +-*/ 5.6", None, "c", 14),
        (8, "Äußerst schöne Größen 日本 語 🙂 naïve", "de", "c", None),
        (None, "a row without an id has words of its own and a few more", None, None, None),
        (None, None, None, None, None),
        (9, "x" * 300_000, "en", "a", 300_000),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", *(f"'clash' AS `{name}`" for name in CLASHES))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def by_id(df):
    return {row["doc_id"]: row for row in df.collect()}
