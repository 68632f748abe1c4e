"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions import dates, paths, states, text
from tidefold.operators import (
    accounting,
    classify,
    dating,
    filters,
    lookups,
    placement,
    report,
    sketches,
    snapshots,
)
from tidefold.operators.skew import measure_hot_keys
from tidefold.plans.ingest import Target, estimate_run, recover_runs
from tidefold.session import Scratch
from tidefold.sources import ledger as ledgers
from tidefold.sources import buckets, listing, pathindex, sinks, treehash
from tidefold.sources.tags import flatten_tags
from tidefold.verify import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ROW_COLUMNS = ("path", "dest_path", "state", "existing_path", "error")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def keyed_inventory(spark, sf_dir):
    """Inventory with its destination by mtime month."""
    dated = fx.inventory(spark, sf_dir).withColumn("date_wall", dates.wall_clock(F.col("mtime")))
    return classify.with_destination(dated, fx.DEST)


def dated_inventory(spark, sf_dir):
    return dating.best_date(fx.faulty_inventory(spark, sf_dir), fx.tags(spark, sf_dir))


# Sources and sinks


def _written_texts(spark, sf_dir, scratch):
    """The folder of the documents written as text files by source."""
    folder = f"{scratch.path}/texts"
    fx.table(spark, sf_dir, "documents").select("source", "text").write.partitionBy("source").text(folder)
    return folder


@query
def inventory_scan(spark, sf_dir):
    """The documents written as text files by source, listed by tasks, and summed by folder."""
    scratch = Scratch(spark)
    found, _ = listing.walk_tree(spark, _written_texts(spark, sf_dir, scratch), scratch)
    source = F.regexp_extract("path", r"/source=([^/]*)/part-[^/]*\.txt$", 1)
    return (
        found.select(source.alias("source"), "size")
        .where("source <> ''")
        .groupBy("source")
        .agg(F.sum("size").cast("bigint").alias("bytes"))
    )


@query
def walk_order(spark, sf_dir):
    return fx.inventory(spark, sf_dir).select(
        "path", F.hex(paths.walk_key(F.col("path"))).alias("walk_key")
    )


@query
def scan_errors(spark, sf_dir):
    """A walk over the written documents and, for some of them, a folder that is not there."""
    scratch = Scratch(spark)
    written = _written_texts(spark, sf_dir, scratch)
    missing = fx.unreadable(spark, sf_dir).select(F.concat(F.lit(written), "path").alias("path"))
    roots = spark.createDataFrame([(written,)], "path string").unionByName(missing)
    _, errors = listing.walk_tree(spark, roots, scratch)
    return errors.select(F.replace("path", F.lit(written), F.lit("")).alias("path"), "message")


@query
def ledger_load(spark, sf_dir):
    return ledgers.known_hashes(fx.worn(fx.full_ledger(spark, sf_dir)))


@query
def dest_listing(spark, sf_dir):
    """Keys taken, read back from a written payload table."""
    folder = f"{Scratch(spark).path}/payload"
    month = F.element_at(F.split("dest_path", "/"), -2)
    sinks.write_months(fx.full_ledger(spark, sf_dir).withColumn("month", month), folder)
    return listing.dest_listing(spark.read.parquet(folder))


@query
def content_hash(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id",
        listing.content_digest(F.col("text")).alias("md5"),
        listing.content_digest(F.col("text"), "sha256").alias("sha256"),
    )


@query
def content_tree_hash(spark, sf_dir):
    """Texts cut into parts of 100 bytes, combined eight by eight."""
    return treehash.tree_hash(fx.table(spark, sf_dir, "documents"), "doc_id", "text", 100, 8)


@query
def snapshot_difference(spark, sf_dir):
    return snapshots.difference(fx.earlier_snapshot(spark, sf_dir), fx.snapshot(spark, sf_dir))


@query
def carried_hashes(spark, sf_dir):
    """What of a listing without hashes need not be hashed again."""
    listed = fx.snapshot(spark, sf_dir).drop("hash")
    return snapshots.with_carried_hash(listed, fx.earlier_snapshot(spark, sf_dir)).select("path", "hash")


@query
def month_partition_sink(spark, sf_dir):
    run = fx.run(spark, sf_dir)
    folder = f"{run.scratch.path}/payload"
    payload = fx.base(spark, sf_dir).select("path", "text")
    sinks.write_months(sinks.accepted_payload(run.results(), payload), folder)
    return spark.read.parquet(folder).select(
        F.col("month").cast("string").alias("month"),
        "path",
        "dest_path",
        dates.wall_clock(F.col("mtime")).alias("mtime"),
        F.md5("text").alias("content"),
    )


@query
def ledger_append(spark, sf_dir):
    folder = f"{Scratch(spark).path}/ledger"
    fx.ledger(spark, sf_dir).write.parquet(folder)
    rows = filters.allow_listed(keyed_inventory(spark, sf_dir)).select(
        F.col("path").alias("src_path"),
        "dest_path",
        "hash",
        "size",
        F.unix_seconds("mtime").alias("mtime"),
        F.lit(fx.AS_OF).alias("copied_at"),
    )
    ledgers.append_ledger(rows, ledgers.open_ledger(spark, folder), folder)
    return ledgers.open_ledger(spark, folder).withColumn(
        "copied_at", dates.wall_clock(F.col("copied_at"))
    )


@query
def run_recovery(spark, sf_dir):
    """A run that died among its files, completed: the ledger then, and what is due again."""
    scratch = Scratch(spark)
    target = Target(fx.DEST, f"{scratch.path}/payload", f"{scratch.path}/ledger", f"{scratch.path}/report")
    fx.plant_died_run(spark, sf_dir, target)
    recover_runs(spark, target, scratch)
    recorded = ledgers.open_ledger(spark, target.ledger_table).select(
        F.lit("ledger").alias("kind"), F.col("src_path").alias("path"), "hash"
    )
    due = target.journal(spark).due().select(F.lit("due").alias("kind"), "path", F.lit(None).cast("string").alias("hash"))
    return recorded.unionByName(due)


@query
def incremental_retry(spark, sf_dir):
    """Rows newer than the last copy, or due again by path or by a folder above."""
    rows, known = fx.inventory(spark, sf_dir), fx.ledger(spark, sf_dir)
    passed = classify.split_early(rows, ledgers.watermark_seconds(known), fx.due(spark, sf_dir))[1]
    return passed.select("path", "size")


def _bucketed(spark, sf_dir):
    """The worn ledger in buckets, appended in two steps."""
    ledger = buckets.create_bucketed(spark, f"{Scratch(spark).path}/ledger", 16, 1_000)
    worn = fx.worn(fx.ledger(spark, sf_dir))
    for half in (0, 1):
        ledger.append(worn.where(F.col("size") % 2 == half))
    return ledger


@query
def bucketed_duplicates(spark, sf_dir):
    """``ledger_duplicates`` against a bucketed ledger, which is joined where it lies."""
    rows = fx.inventory(spark, sf_dir)
    known = _bucketed(spark, sf_dir).rows()
    found = lookups.ledger_duplicates(rows, known, measure_hot_keys(rows, "hash"), stay=True)
    return found.select("path", "hash", "existing_path")


@query
def filtered_duplicates(spark, sf_dir):
    """The contents of the inventory that a bucketed ledger has, new ones told by its filter."""
    found = _bucketed(spark, sf_dir).known_among(fx.inventory(spark, sf_dir))
    return found.withColumnRenamed("dest_path", "existing_path")


@query
def report_sink(spark, sf_dir):
    folder = f"{Scratch(spark).path}/report"
    rows = report_rows(spark, sf_dir)
    sinks.write_report(rows, folder, "json")
    return spark.read.schema(rows.schema).json(folder)


# Scalar functions


@query
def normalize_ext(spark, sf_dir):
    return fx.inventory(spark, sf_dir).select("path", paths.extension(F.col("path")).alias("ext"))


@query
def basename(spark, sf_dir):
    return fx.inventory(spark, sf_dir).select("path", paths.basename(F.col("path")).alias("name"))


@query
def month_bucket(spark, sf_dir):
    wall = dates.wall_clock(F.col("mtime"))
    return fx.inventory(spark, sf_dir).select("path", dates.month_of(wall).alias("month"))


@query
def dest_path(spark, sf_dir):
    return keyed_inventory(spark, sf_dir).select("path", "dest_path")


@query
def state_label(spark, sf_dir):
    code = F.col("doc_id") % 13
    return fx.base(spark, sf_dir).select("doc_id", states.state_label(code).alias("label"))


@query
def extractor_eligibility(spark, sf_dir):
    return dating.extractor_eligibility(fx.inventory(spark, sf_dir))


@query
def confidence_label(spark, sf_dir):
    rank = F.col("doc_id") % 5
    return fx.base(spark, sf_dir).select("doc_id", dates.confidence_label(rank).alias("label"))


@query
def parse_tag_date(spark, sf_dir):
    value = F.col("value")
    return fx.date_texts(spark, sf_dir).select(
        "event_id",
        "value",
        dates.parse_tag_date(value).alias("wall"),
        dates.parse_tag_date(value, ("colon",)).alias("exif_wall"),
    )


@query
def confidence_downgrade(spark, sf_dir):
    ext = paths.extension(F.col("path"))
    label = dates.confidence_label(dates.tag_confidence(ext))
    return fx.inventory(spark, sf_dir).select("path", label.alias("label"))


@query
def relative_path(spark, sf_dir):
    path = F.col("path")
    untidy = F.replace(path, F.lit("/b"), F.lit("//./b"))
    return fx.inventory(spark, sf_dir).select(
        "path",
        paths.relative_path(untidy, f"{fx.SRC}/").alias("shown"),
        paths.relative_path(path, "/dest/photos").alias("shown_outside"),
        paths.relative_path(path, "").alias("unchanged"),
    )


@query
def human_size(spark, sf_dir):
    return fx.sizes(spark, sf_dir).select("doc_id", text.human_size(F.col("size")).alias("shown"))


@query
def parse_size(spark, sf_dir):
    shown = text.human_size(F.col("size"))
    return fx.sizes(spark, sf_dir).select("doc_id", text.parse_size(shown).alias("bytes"))


@query
def human_duration(spark, sf_dir):
    return fx.spans(spark, sf_dir).select(
        "o_orderkey", text.human_duration(F.col("seconds")).alias("shown")
    )


@query
def human_age(spark, sf_dir):
    return fx.spans(spark, sf_dir).select(
        "o_orderkey", text.human_age(F.col("seconds")).alias("shown")
    )


@query
def ago_text(spark, sf_dir):
    return fx.spans(spark, sf_dir).select(
        "o_orderkey", text.ago_text(F.col("seconds")).alias("shown")
    )


def _messages(spark, sf_dir):
    failed = fx.faulty_inventory(spark, sf_dir).select(
        states.error_message(
            F.col("path"), F.col("read_error"), F.lit(states.ERROR_HASH)
        ).alias("message")
    )
    unread = fx.scan_errors(spark, sf_dir).select(
        states.walk_error_message(F.col("path"), F.col("message")).alias("message")
    )
    return failed.unionByName(unread)


@query
def error_message(spark, sf_dir):
    return _messages(spark, sf_dir)


@query
def split_error_message(spark, sf_dir):
    message = F.col("message")
    return _messages(spark, sf_dir).select(
        "message",
        states.message_path(message).alias("path"),
        states.message_detail(message).alias("details"),
    )


@query
def tag_flatten(spark, sf_dir):
    return flatten_tags(fx.container_json(spark, sf_dir))


# Filters


@query
def ext_allow_list(spark, sf_dir):
    return filters.allow_listed(fx.inventory(spark, sf_dir)).select("path", "size")


@query
def incremental_filter(spark, sf_dir):
    rows = fx.inventory(spark, sf_dir)
    return filters.incremental_filter(rows, fx.ledger(spark, sf_dir)).select("path", "size")


@query
def valid_date_filter(spark, sf_dir):
    dated = dating.effective_date(dated_inventory(spark, sf_dir))
    return filters.valid_date_filter(dated).select("path", "date_wall")


@query
def report_filter(spark, sf_dir):
    return filters.report_filter(report_rows(spark, sf_dir), "skipped", "Img_0000")


@query
def report_search(spark, sf_dir):
    """``report_filter`` by the index of a written report."""
    folder = f"{Scratch(spark).path}/report"
    pathindex.write_indexed(report_rows(spark, sf_dir), folder, 16)
    return pathindex.search(spark, folder, "skipped", "Img_0000")


# Dates


@query
def exif_date(spark, sf_dir):
    return dating.exif_date(fx.tags(spark, sf_dir))


@query
def video_date(spark, sf_dir):
    return dating.video_date(fx.tags(spark, sf_dir))


@query
def mtime_date(spark, sf_dir):
    return dating.mtime_date(fx.faulty_inventory(spark, sf_dir))


@query
def best_date(spark, sf_dir):
    return dated_inventory(spark, sf_dir).select("path", "date_wall", "confidence", "source")


@query
def effective_date(spark, sf_dir):
    return dating.effective_date(dated_inventory(spark, sf_dir)).select("path", "date_wall")


@query
def date_source_profile(spark, sf_dir):
    return dating.date_source_profile(dated_inventory(spark, sf_dir))


# Lookups


@query
def ledger_duplicates(spark, sf_dir):
    rows, known = fx.inventory(spark, sf_dir), fx.worn(fx.ledger(spark, sf_dir))
    found = lookups.ledger_duplicates(rows, known, measure_hot_keys(rows, "hash"))
    return found.select("path", "hash", "existing_path")


@query
def dest_exists(spark, sf_dir):
    rows, listed = keyed_inventory(spark, sf_dir), fx.dest_listing(fx.ledger(spark, sf_dir))
    found = lookups.dest_exists(rows, listed, measure_hot_keys(rows, "dest_path"))
    return found.select("path", "dest_path")


@query
def new_content(spark, sf_dir):
    rows, known = keyed_inventory(spark, sf_dir), fx.ledger(spark, sf_dir)
    hot = [measure_hot_keys(rows, column) for column in ("hash", "dest_path")]
    worn = fx.worn(fx.ledger(spark, sf_dir))
    fresh = lookups.new_content(rows, worn, fx.dest_listing(known), *hot)
    return fresh.select("path", "dest_path", "hash")


@query
def insert_or_ignore(spark, sf_dir):
    rows, known = fx.inventory(spark, sf_dir), fx.worn(fx.ledger(spark, sf_dir))
    kept = lookups.insert_or_ignore(rows, known, measure_hot_keys(rows, "hash"))
    return kept.select("path", "hash")


# Classification and placement


def _planned(spark, sf_dir):
    run = fx.run(spark, sf_dir)
    return classify.plan_classification(run.inventory, run.listing, run.mark, fx.DEST)


@query
def plan_classification(spark, sf_dir):
    return _planned(spark, sf_dir)


@query
def static_classification(spark, sf_dir):
    return fx.run(spark, sf_dir).static().select(*ROW_COLUMNS)


@query
def greedy_placement(spark, sf_dir):
    """Placement alone, over every accepted file, with no earlier runs."""
    rows = filters.allow_listed(keyed_inventory(spark, sf_dir))
    placed = placement.greedy_placement(rows.select("path", "dest_path", "hash"), Scratch(spark))
    return placed.select("path", "dest_path", "state", "existing_path")


@query
def final_results(spark, sf_dir):
    return fx.run(spark, sf_dir).results().select(*ROW_COLUMNS, "month", "bytes_copied")


@query
def content_duplicate_groups(spark, sf_dir):
    return accounting.content_duplicate_groups(fx.inventory(spark, sf_dir))


@query
def content_duplicate_pairs(spark, sf_dir):
    rows = fx.inventory(spark, sf_dir)
    return accounting.content_duplicate_pairs(rows, measure_hot_keys(rows, "hash"))


# Accounting


@query
def plan_estimate(spark, sf_dir):
    return accounting.plan_estimate(_planned(spark, sf_dir))


@query
def distinct_estimate(spark, sf_dir):
    """Contents and bytes that a run's rows come to, from two sketches merged."""
    rows = fx.inventory(spark, sf_dir)
    halves = [sketches.sketch(rows.where(F.col("size") % 2 == half), 128) for half in (0, 1)]
    return sketches.totals(sketches.merge(*halves, 128), 128).select("contents", "bytes")


@query
def capacity_gate(spark, sf_dir):
    run = fx.run(spark, sf_dir)
    return estimate_run(run, run.mark, fx.DEST, fx.AVAILABLE_BYTES)


@query
def accounting_summary(spark, sf_dir):
    run = fx.run(spark, sf_dir)
    return accounting.accounting_summary(run.results(), run.scan_errors)


@query
def accounting_by_state(spark, sf_dir):
    return accounting.accounting_by_state(fx.run(spark, sf_dir).results())


@query
def reconciliation(spark, sf_dir):
    return accounting.reconciliation(accounting_summary(spark, sf_dir))


@query
def watermark(spark, sf_dir):
    last = dates.wall_clock(F.col("last_backup")).alias("last_backup")
    return ledgers.watermark(fx.full_ledger(spark, sf_dir)).select(last)


@query
def ledger_status(spark, sf_dir):
    return ledgers.ledger_status(fx.worn(fx.full_ledger(spark, sf_dir)), fx.AS_OF)


@query
def oldest_file_age(spark, sf_dir):
    return accounting.oldest_file_age(fx.run(spark, sf_dir).results(), fx.AS_OF)


@query
def report_badges(spark, sf_dir):
    run = fx.run(spark, sf_dir)
    return accounting.report_badges(run.results(), run.scan_errors, fx.SECONDS_TAKEN)


@query
def run_context(spark, sf_dir):
    run = fx.run(spark, sf_dir)
    return accounting.run_context(run.results(), run.scan_errors, run.ledger, True, fx.AS_OF)


@query
def outcome_bucket(spark, sf_dir):
    return accounting.outcome_bucket(accounting_summary(spark, sf_dir))


@query
def recency_bucket(spark, sf_dir):
    return accounting.recency_bucket(run_context(spark, sf_dir), fx.AS_OF)


@query
def month_totals(spark, sf_dir):
    return accounting.month_totals(fx.run(spark, sf_dir).results())


# Report


@query
def report_rows(spark, sf_dir):
    run = fx.run(spark, sf_dir)
    return report.report_rows(run.results(), run.scan_errors, fx.SRC, fx.DEST)


@query
def report_sort(spark, sf_dir):
    return report.report_sort(report_rows(spark, sf_dir), "size", ascending=False)


@query
def error_rows(spark, sf_dir):
    run = fx.run(spark, sf_dir)
    return report.error_rows(run.results(), run.scan_errors)
