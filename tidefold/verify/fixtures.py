"""Operator inputs derived from the driver's tables, all of them projections of
``documents`` or ``events`` that grow with the data."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidefold.functions.dates import EXTRACTORS, wall_clock
from tidefold.functions.paths import ALLOWED_EXTENSIONS, destination, extension
from tidefold.operators.classify import static_classification
from tidefold.plans.ingest import Inputs, Target, classify_run
from tidefold.schemas import LEDGER
from tidefold.session import Scratch
from tidefold.sources.journal import DUE_ROW, PLANNED
from tidefold.sources.ledger import add_rows, watermark_seconds
from tidefold.sources.listing import split_walk

SRC, DEST = "/src", "/dest"
AS_OF = datetime(2024, 3, 5, 12, 34, 56, tzinfo=timezone.utc)
LAST_RUN = datetime(2024, 1, 10, tzinfo=timezone.utc)
AVAILABLE_BYTES = 107_000_000
SECONDS_TAKEN = 83.0

# Suffixes as the fixture writes them.
SUFFIXES = (
    ".jpg", ".JPG", ".jpeg", ".heic", ".png", ".mp4", ".MOV", ".mkv", ".webm", ".avi",
    ".txt", ".heif",
)
MONTH_EDGE = "2024-01-31T23:30:00-05:00"


SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; its schema is looked up in the file once only."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, path, mtime, size, hash, text``, without faults."""
    doc = F.col("doc_id")
    number = F.when(doc % 9 == 0, F.greatest(doc - 12, F.lit(0))).otherwise(doc)
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in SUFFIXES]), (doc % len(SUFFIXES) + 1).cast("int")
    )
    folder = F.call_function("div", doc, F.lit(240))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.lit(f"{SRC}/"), "source", F.lit("/b"), folder, F.lit("/IMG_"),
            F.format_string("%06d", number), suffix,
        ).alias("path"),
        F.timestamp_seconds(F.lit(1_704_067_200) + doc * 7919 % 86_400 * 60).alias("mtime"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.md5("text").alias("hash"),
        "text",
    )


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("path", "mtime", "size", "hash")


def faulty_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory with unreadable rows and rows without mtime."""
    unreadable = F.col("doc_id") % 53 == 0
    return base(spark, sf_dir).select(
        "path",
        F.when(F.col("doc_id") % 61 != 5, F.col("mtime")).alias("mtime"),
        "size",
        F.when(~unreadable, F.col("hash")).alias("hash"),
        F.when(unreadable, "permission denied").alias("read_error"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier run recorded, when a tenth of the documents were there."""
    return _recorded(base(spark, sf_dir).where("doc_id % 10 = 0"), F.lit(LAST_RUN))


def full_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of all documents, each copied a day after its last change."""
    return _recorded(base(spark, sf_dir), F.expr("row.mtime + INTERVAL 1 DAY"))


def _recorded(rows: DataFrame, copied_at: Column) -> DataFrame:
    rows = rows.where(extension(F.col("path")).isin(*ALLOWED_EXTENSIONS))
    first = F.min_by(F.struct("path", "size", "mtime"), "doc_id").alias("row")
    month = F.date_format("row.mtime", "yyyy-MM")
    return (
        rows.groupBy("hash")
        .agg(first)
        .select(
            F.col("row.path").alias("src_path"),
            destination(DEST, month, F.col("row.path")).alias("dest_path"),
            "hash",
            "row.size",
            F.unix_seconds("row.mtime").alias("mtime"),
            copied_at.alias("copied_at"),
        )
    )


def worn(rows: DataFrame) -> DataFrame:
    """A ledger after appends that were repeated, and rows whose hash was lost."""
    again = rows.where("size % 2 = 0").withColumns({
        "dest_path": F.concat("dest_path", F.lit("~")),
        "hash": F.when(F.col("size") % 3 > 0, F.col("hash")),
    })
    return rows.unionByName(again)


def dest_listing(ledger: DataFrame) -> DataFrame:
    return ledger.select("dest_path").distinct()


def unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path`` of folders that cannot be listed."""
    refused = base(spark, sf_dir).where("doc_id % 97 = 0")
    return refused.select(F.concat(F.lit(f"{SRC}/unreadable/"), "doc_id").alias("path"))


def due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that failed in an earlier run, and folders that it could not list."""
    rows = base(spark, sf_dir)
    files = rows.where("doc_id % 50 = 7").select("path", F.lit("file").alias("kind"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    folders = rows.where("doc_id % 240 = 17 and doc_id % 7 < 3").select(folder.alias("path"), F.lit("folder").alias("kind"))
    return files.unionByName(folders).withColumn("reason", F.lit("permission denied"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of documents, less some, each at a path of its own."""
    path = F.concat(F.lit("/s/"), F.regexp_extract("path", "^/src/([^/]*)/", 1), F.lit("/"), "doc_id", F.lit(".jpg"))
    return base(spark, sf_dir).where("doc_id % 19 <> 6").select(path.alias("path"), "size", "mtime", "hash")


def earlier_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier one: some documents not yet there, some elsewhere, some with other content."""
    doc = F.col("doc_id")
    folder = F.when(doc % 13 == 4, "/old/").otherwise("/s/")
    path = F.concat(folder, F.regexp_extract("path", "^/src/([^/]*)/", 1), F.lit("/"), "doc_id", F.lit(".jpg"))
    other = doc % 17 == 5
    return base(spark, sf_dir).where("doc_id % 11 <> 3").select(
        path.alias("path"),
        F.when(other, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        "mtime",
        F.when(other, F.md5("hash")).otherwise(F.col("hash")).alias("hash"),
    )


def plant_died_run(spark: SparkSession, sf_dir: str, target: Target) -> None:
    """A run that planned a ledger's rows and died.

    By size mod 6: nothing of 0 landed, part 0 of two of 3, all of the rest. The ledger
    had got those of a size divisible by 4.
    """
    one = F.min_by(F.struct(*LEDGER.names), "hash").alias("row")
    rows = full_ledger(spark, sf_dir).groupBy("dest_path").agg(one).select("row.*")
    journal = target.journal(spark)
    run = journal.new_run(AS_OF)
    month = F.element_at(F.split("dest_path", "/"), -2).alias("month")
    planned = rows.select(
        F.col("src_path").alias("path"), "dest_path", month, "hash", "size",
        F.timestamp_seconds("mtime").alias("mtime"), F.lit(AS_OF).alias("copied_at"),
    )
    journal.write("planned", run, planned)
    journal.write("due", run, spark.createDataFrame([], DUE_ROW))
    journal.mark(run, PLANNED, AS_OF)
    kind = F.col("size") % 6
    parts = F.when(kind.isin(2, 3), 2).otherwise(1)
    landed = planned.where(kind != 0).select(
        "*", parts.cast("bigint").alias("parts"), F.lit(b"").alias("content"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(kind == 2, 1).otherwise(0).cast("bigint"))).alias("part"),
    )
    landed.write.partitionBy("month").parquet(target.payload_of(run))
    add_rows(rows.where("size % 4 = 0"), target.ledger_table)


def walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk meets: a file per document, or a folder it may not enter."""
    refused = F.col("doc_id") % 97 == 0
    return base(spark, sf_dir).select(
        F.when(refused, "error").otherwise("file").alias("kind"),
        F.when(refused, F.concat(F.lit(f"{SRC}/unreadable/"), "doc_id")).otherwise(F.col("path")).alias("path"),
        F.when(~refused, F.unix_micros("mtime")).alias("mtime_us"),
        F.when(~refused, F.col("size")).alias("size"),
        F.when(refused, "permission denied").alias("message"),
    )


def scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_walk(walked(spark, sf_dir))[1]


def _tag(scope: str, tag: str, value: Column, index: int = -1) -> Column:
    return F.struct(
        F.lit(scope).alias("scope"),
        F.lit(tag).alias("tag"),
        F.lit(index).alias("stream_index"),
        value.alias("value"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext, kind, spaced = F.col("ext"), F.col("kind"), F.col("spaced")
    colon = F.replace(spaced, F.lit("-"), F.lit(":"))
    zulu = F.concat(F.replace(spaced, F.lit(" "), F.lit("T")), F.lit(".000000Z"))
    image = ext.isin(*EXTRACTORS["EXIF"])
    video = ext.isin(*EXTRACTORS["Video"])
    files = base(spark, sf_dir).select(
        "path",
        extension(F.col("path")).alias("ext"),
        (F.col("doc_id") % 7).alias("kind"),
        wall_clock(F.expr("mtime - INTERVAL 40 DAYS")).alias("spaced"),
    )
    rows = (
        F.when(image & (kind == 0), F.array(
            _tag("exif", "DateTimeOriginal", colon), _tag("exif", "DateTime", colon)))
        .when(image & (kind == 1), F.array(
            _tag("exif", "DateTimeOriginal", F.lit("0000:00:00 00:00:00")),
            _tag("exif", "DateTimeDigitized", colon)))
        .when(image & (kind == 2), F.array(_tag("exif", "DateTime", colon)))
        .when(video & (kind == 0), F.array(_tag("format", "creation_time", zulu)))
        .when(video & (kind == 1), F.array(
            _tag("format", "creation_time", F.lit("2023")), _tag("format", "date", spaced)))
        .when(video & (kind == 2), F.array(
            _tag("format", "com.apple.quicktime.creationdate", F.lit(MONTH_EDGE))))
        .when(video & (kind == 3), F.array(
            _tag("stream", "creation_time", F.lit(""), 0),
            _tag("stream", "creation_time", colon, 1)))
    )
    return files.select("path", F.explode(rows).alias("row")).select("path", "row.*")


def container_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, metadata``: the container and stream tags as one JSON text."""
    tall = tags(spark, sf_dir).where("scope <> 'exif'")
    at_format = F.collect_list(F.when(F.col("scope") == "format", F.struct("tag", "value")))
    # At most two streams per path, so the list is bounded.
    at_stream = F.array_sort(
        F.collect_list(F.when(F.col("scope") == "stream", F.struct("stream_index", "tag", "value")))
    )
    return tall.groupBy("path").agg(at_format.alias("f"), at_stream.alias("s")).select(
        "path",
        F.to_json(
            F.struct(
                F.struct(F.map_from_entries("f").alias("tags")).alias("format"),
                F.transform(
                    "s",
                    lambda one: F.struct(F.create_map(one["tag"], one["value"]).alias("tags")),
                ).alias("streams"),
            )
        ).alias("metadata"),
    )


def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, value``: event times written in accepted and refused forms."""
    ts, kind = F.col("ts"), F.col("event_id") % 12
    day, clock = F.date_format(ts, "yyyy-MM-dd"), F.date_format(ts, "HH:mm:ss")
    colon_day = F.date_format(ts, "yyyy:MM:dd")
    late = F.date_format(ts, "H:mm:ss")
    forms = [
        F.concat(day, F.lit("T"), clock, F.lit("Z")),
        F.concat(day, F.lit("T"), clock, F.lit(".125+05:30")),
        F.concat(day, F.lit("T"), clock),
        F.concat(day, F.lit(" "), clock),
        F.concat(colon_day, F.lit(" "), clock),
        F.concat(day, F.lit("T"), clock, F.lit("+0200")),
        day,
        F.concat(F.date_format(ts, "yyyy-MM-"), F.lit("31 "), clock),
        F.concat(colon_day, F.lit("  "), late, F.lit(",5")),
        F.concat(day, F.lit(" "), clock, F.lit("Z")),
        F.concat(F.date_format(ts, "yyyy-00-dd"), F.lit(" "), clock),
        F.lit(""),
    ]
    value = F.element_at(F.array(*forms), (kind + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", value.alias("value"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``o_orderkey, seconds``: spans from seconds to years."""
    number = F.col("o_orderkey") * 7919
    seconds = (
        F.when(F.col("o_orderkey") % 4 == 0, number % 7_300)
        .when(F.col("o_orderkey") % 4 == 1, number % 260_000)
        .when(F.col("o_orderkey") % 4 == 2, number % 6_000_000)
        .otherwise(number % 200_000_000)
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", seconds.alias("seconds"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size``: text sizes scaled up to petabytes, and zeros."""
    scale = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("doc_id") % 40).cast("int"))
    size = F.when(F.col("doc_id") % 31 == 0, F.lit(0)).otherwise(
        F.octet_length("text").cast("bigint") * scale
    )
    return table(spark, sf_dir, "documents").select("doc_id", size.cast("bigint").alias("size"))


@dataclass
class Run(Inputs):
    """Everything one run works on."""

    scratch: Scratch | None = None

    @property
    def mark(self) -> Column:
        return watermark_seconds(self.ledger)

    def static(self) -> DataFrame:
        return static_classification(
            self.inventory, self.tags, self.listing, self.ledger, self.mark, DEST
        )

    def results(self) -> DataFrame:
        return classify_run(self, self.mark, DEST, self.scratch)


def run(spark: SparkSession, sf_dir: str) -> Run:
    """A run against a written ledger, as any run but the first has one."""
    scratch = Scratch(spark)
    written = scratch.save(ledger(spark, sf_dir), "ledger")
    return Run(
        faulty_inventory(spark, sf_dir),
        tags(spark, sf_dir),
        dest_listing(written),
        written,
        scan_errors(spark, sf_dir),
        scratch=scratch,
    )
