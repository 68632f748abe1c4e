import duckdb

from tidefold.llm.mixing import mix_sources, source_targets
from tidefold.llm.oracles import ORACLES


def shared_in_rounds(sizes, weights, share, cap):
    """Sharing and clamping until no source is above its cap."""
    total, fixed = share * sum(sizes), {}
    while True:
        left = [i for i in range(len(sizes)) if i not in fixed]
        if not left:
            return [fixed[i] for i in range(len(sizes))]
        level = (total - sum(fixed.values())) / sum(weights[i] for i in left)
        over = [i for i in left if level * weights[i] >= cap * sizes[i]]
        if not over:
            return [fixed.get(i, level * weights[i]) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def test_targets_equal_rounds_of_sharing(spark):
    for sizes in ([100, 5, 900, 30, 0, 7], [1, 1, 1], [1000], [0, 0], [10, 10_000, 10, 10]):
        df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        want = shared_in_rounds(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5, 2)
        assert all(abs(got[f"s{i}"] - want[i]) < 1e-6 for i in range(len(sizes))), sizes


def test_words_taken_come_to_the_target(documents):
    rows = mix_sources(documents).collect()
    taken, target = {}, {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert all(taken[s] == int(target[s]) for s in target)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_sources(documents.repartition(7)).collect()))


def test_hostile_rows_equal_sql(spark, hostile, no_docs):
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    got = [tuple(r) for r in mix_sources(hostile).select(columns).collect()]
    documents = hostile.select("doc_id", "text", "source").toArrow()  # noqa: F841  read by the SQL
    want = duckdb.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES['op8_source_mixing']})").fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert mix_sources(no_docs).count() == 0
