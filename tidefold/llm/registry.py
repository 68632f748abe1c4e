"""The registered query of each operator, over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import scratch_of, table
from tidefold.llm.decontaminate import contained_items
from tidefold.llm.filter_audit import WORD, audit_filters
from tidefold.llm.fingerprints import fingerprint_edits, within_radius
from tidefold.llm.language_id import held_out, identify, learn
from tidefold.llm.mixing import mix_sources
from tidefold.llm.near_dedup import near_classes
from tidefold.llm.packing import pack
from tidefold.llm.periodic_runs import periodic_runs
from tidefold.llm.pii import find_personal_data
from tidefold.llm.suffix_dedup import remove_repeats
from tidefold.llm.tokens import token_counts
from tidefold.llm.url_filter import filter_urls
from tidefold.llm.warc import read_archives, write_archives


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    scratch = scratch_of(pages)
    folder = f"{scratch.path}/archives"
    records = read_archives(write_archives(pages, folder, scratch=scratch), folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With ``rows_near``: of ids divisible by 100, how many rows lie within the radius."""
    docs = table(spark, sf_dir, "documents")
    prints = scratch_of(docs).save(fingerprint_edits(docs), "prints")
    asked = prints.where(F.col("doc_id") % 100 == 0)
    near = within_radius(prints, asked).groupBy(F.col("query").alias("fingerprint")).agg(F.sum("rows").alias("rows_near"))
    # An id may come with several texts; each has its own fingerprint.
    near = asked.select("doc_id", "fingerprint").distinct().join(near, "fingerprint")
    return prints.join(near, ["doc_id", "fingerprint"], "left").select(*prints.columns, "rows_near")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = identify(docs.select("doc_id", "text"), learn(docs))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; one id in ten repeats a stretch of words from some place to its end."""
    key = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # Null for all other documents, whose text stays.
    words = F.when(key % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    repeated = F.expr("transform(words, (w, i) -> if(i < begin, w, get(words, cast(begin + (i - begin) % period as int))))")
    return (
        docs.select("doc_id", "text", F.floor(key / 10).alias("shift"), words.alias("words"))
        .withColumn("begin", F.pmod("shift", F.greatest(F.size("words"), F.lit(1))))
        .withColumn("period", F.expr("1 + (size(words) - begin) div (3 + shift % 8)"))
        .select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(F.concat_ws(" ", repeated)).alias("text"))
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    # The first run of the greatest exact length / period.
    best = F.expr(
        "aggregate(slice(runs, 2, size(runs)), get(runs, 0), "
        "(best, r) -> if(r.length * best.period > best.length * r.period, r, best))"
    )
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_warc": op3_warc,
    "op4_near_dedup": op4_near_dedup,
    "op5_fingerprints": op5_fingerprints,
    "op6_language_id": op6_language_id,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_token_counts": op9_token_counts,
    "op10_personal_data": op10_personal_data,
    "op11_packing": op11_packing,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}
