"""The pipeline's stages against what the operators' own tests hold them to."""

import corpus_pipeline as cp
import __spark_entry__ as entry
from tidefold.llm import pii
from tidefold.llm.decontaminate import contained_items
from tidefold.llm.near_dedup import near_classes
from tidefold.session import Scratch

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contract(spark, documents):
    scratch, docs = Scratch(spark), documents
    kept = {}
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        after = scratch.save(stage(spark, docs, SF), f"s{k}")
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes)
        kept[name] = (docs, after)
        docs = after
    before, after = kept["language_id"]
    assert after.count() >= 0.99 * before.where("text rlike '[a-z]'").count()
    before, after = kept["near_dedup"]
    classes = near_classes(before).collect()
    assert {r["doc_id"] for r in after.collect()} == {r["class_id"] for r in classes}
    before, after = kept["decontamination"]
    leaks = {r["doc_id"] for r in contained_items(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - leaks
    before, after = kept["personal_data"]
    old = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        if not pii.stretches(old[r["doc_id"]]):
            assert r["text"] == old[r["doc_id"]]
    mixed = cp.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() == docs.count()


def test_run_and_registration(spark):
    assert entry.queries()["pipeline"](spark, SF).count() > 0
    assert {f"op{n}" for n in range(1, 11)} <= {name.split("_")[0] for name in entry.queries()}


def test_hostile_rows_and_empty_tables(spark, hostile, no_docs):
    for docs in (hostile, no_docs):
        scratch, columns = Scratch(spark), docs.columns
        for k, (_, stage) in enumerate(cp.STAGES[:-1]):
            docs = scratch.save(stage(spark, docs, SF), f"s{k}")
            assert docs.columns == columns
        cp.STAGES[-1][1](spark, docs, SF).collect()
