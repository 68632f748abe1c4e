"""The corpus pipeline: documents through five operators of ``tidefold.llm``.

Defined results. Null and empty texts, and texts without a letter, have no language and go
in the first stage, with or without an id. Rows without an id take part in all stages; the
second keeps each of them, as nothing names them. Of rows that repeat an id and a text one
stays; rows of one id and different texts are different documents throughout. The third
stage goes by text: equal texts stay or go together. The fourth keeps every row, masks
what it finds and brings ``n_chars`` up to date. The last one returns a row per document
left. A null source is a source of its own. Very long texts are taken whole, each in one
task, in memory that follows the longest. Extra columns, whatever their names, are carried
to the last stage, which returns its own. An empty table, or one of which nothing is left,
gives no rows; without benchmark items the third stage keeps everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import free_name, scratch_of, table
from tidefold.llm.decontaminate import clean_documents
from tidefold.llm.language_id import UNDETERMINED, identify, learn
from tidefold.llm.mixing import mix_sources
from tidefold.llm.near_dedup import one_of_each
from tidefold.llm.pii import mask_personal_data

# Below this posterior no language stands out.
LEAST_SCORE = 0.5


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the labelled rows teach; text alone decides."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    judged = identify(docs, learn(docs), (lang, score))
    kept = (F.col(lang) != UNDETERMINED) & (F.col(score) >= LEAST_SCORE)
    return judged.where(kept).select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return mask_personal_data(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document so that sources meet their targets."""
    return mix_sources(docs)


STAGES = [
    ("language_id", known_languages),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("source_mixing", mixed),
]

# Language models, sketches and a sequence model decide; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    scratch = scratch_of(docs)
    for step, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{step}")
    return docs
