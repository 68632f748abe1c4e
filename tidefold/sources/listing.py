"""Listings: what lies in a folder, what could not be read, content digests."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tidefold.session import Scratch
from tidefold.sources import storage

DIGESTS = ("md5", "sha256")


def inventory_scan(spark: SparkSession, root: str, suffixes: str | None = None) -> DataFrame:
    """Files below a root as ``path, mtime, size``; any file system Spark reads.

    Content is never selected, so it is not read; filters on mtime and size
    reach the listing. The file index lives on the driver and leaves out names
    that begin with a dot or an underscore; ``walk_tree``, for any number of files,
    has neither limit.
    """
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("ignoreMissingFiles", True)
    )
    if suffixes:
        reader = reader.option("pathGlobFilter", suffixes)
    return reader.load(root).select(
        plain_path(F.col("path")).alias("path"),
        F.col("modificationTime").alias("mtime"),
        F.col("length").alias("size"),
    )


def plain_path(uri: Column) -> Column:
    """``file:/a`` and ``file:///a`` as ``/a``; other schemes are kept."""
    return F.regexp_replace(uri, r"\Afile:/*/", "/")


def content_digest(content: Column, digest: str = "md5") -> Column:
    """Hex digest of a text or binary column."""
    if digest not in DIGESTS:
        raise ValueError(f"digest must be one of {DIGESTS}")
    return F.md5(content) if digest == "md5" else F.sha2(content, 256)


LISTED = "kind string, path string, mtime_us bigint, size bigint, message string"
# Rows of a folder leave its task in pieces of so many.
LISTED_ROWS = 10_000


def _entries(read):
    """A function of batches of ``path`` that sends the entries which ``read`` yields per path."""

    def send(batches):
        import pandas as pd

        def frame(rows):
            columns = ["kind", "path", "mtime_us", "size", "message"]
            return pd.DataFrame(rows, columns=columns).astype({"mtime_us": "Int64", "size": "Int64"})

        for batch in batches:
            rows = []
            for path in batch["path"]:
                for row in read(path):
                    rows.append(row)
                    if len(rows) == LISTED_ROWS:
                        yield frame(rows)
                        rows = []
            if rows:
                yield frame(rows)

    return send


def walk_tree(spark: SparkSession, root: str | DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """List folders level by level: ``(inventory, scan_errors)``.

    ``root`` is a folder, or a table of them (``path``), on mounts or on any file system
    that ``storage`` opens. Each level is one Spark job over the folders found by the one
    before, so neither folders nor files pass through the driver, and there is no file
    index. Of mounted files a folder's own task reads the names alone; their times and
    sizes are asked for afterwards, in ranges of names, so that one huge flat folder is
    many tasks' work. Hidden names are kept, links are not followed, and what cannot be
    read is recorded while the walk goes on.
    """
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if isinstance(root, str):
        root = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string")
    folders, seen = scratch.save_measured(root.select("path").distinct(), "walk-roots", F.count(F.lit(1)).alias("folders"))
    levels = []
    while seen["folders"]:
        # One listing per folder is slow work; spread it over all tasks.
        spread = folders.repartition(min(seen["folders"], width))
        level, seen = scratch.save_measured(
            spread.mapInPandas(_entries(storage.list_folder), LISTED),
            f"walk-{len(levels)}",
            F.count_if(F.col("kind") == "folder").alias("folders"),
            F.count_if((F.col("kind") == "file") & F.col("size").isNull()).alias("unknown"),
        )
        levels.append((level, seen["unknown"]))
        folders = level.where("kind = 'folder'").select("path")
    if not levels:
        return split_walk(spark.createDataFrame([], LISTED))
    listed = levels[0][0]
    for level, _ in levels[1:]:
        listed = listed.unionByName(level)
    unknown = (F.col("kind") == "file") & F.col("size").isNull()
    if not any(count for _, count in levels):
        return split_walk(listed)
    names = listed.where(unknown).select("path").repartitionByRange(width, "path")
    facts = scratch.save(names.mapInPandas(_entries(_facts), LISTED), "walk-facts")
    return split_walk(listed.where(~unknown).unionByName(facts))


def _facts(path: str):
    yield storage.file_facts(path)


def split_walk(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(inventory, scan_errors)`` of what a walk met, by its ``kind``."""
    inventory = listed.where("kind = 'file'").select(
        "path", F.timestamp_micros("mtime_us").alias("mtime"), "size"
    )
    errors = listed.where("kind = 'error'").select("path", "message")
    return inventory, errors


# Content one task reads, and what opening a file counts for.
TASK_BYTES = 1 << 30
OPEN_BYTES = 1 << 18


def spread_by_content(
    files: DataFrame, groups: tuple[str, ...] = (), at_least: int = 1, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """The files dealt to tasks by the bytes they hold, those of a group side by side.

    A task gets ``task_bytes`` or less (if ``at_least`` tasks are asked for) and at
    most one file beyond them: rows of a listing are small, so partitions sized by
    rows would read far too much each. Bytes are summed within buckets, and over the
    buckets before, of which there are a fixed number for each group.
    """
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weight = F.greatest(F.coalesce("size", F.lit(0)), F.lit(OPEN_BYTES))
    weighed = files.withColumns({"_weight": weight, "_bucket": F.pmod(F.xxhash64("path"), F.lit(width))})
    total = weighed.agg(F.sum("_weight")).first()[0] or 0
    tasks = max(at_least, ceil(total / task_bytes))
    key = [*groups, "_bucket"]
    earlier = (Window.unboundedPreceding, -1)
    within = Window.partitionBy(*key).orderBy("path").rowsBetween(*earlier)
    sums = weighed.groupBy(*key).agg(F.sum("_weight").alias("_all"))
    over = F.sum("_all").over(Window.orderBy(*key).rowsBetween(*earlier))
    starts = sums.select(*key, F.coalesce(over, F.lit(0)).alias("_start"))
    before = F.col("_start") + F.coalesce(F.sum("_weight").over(within), F.lit(0))
    # Whole numbers, divided and never multiplied: sums of bytes reach far beyond petabytes.
    share = max(1, ceil(total / tasks))
    placed = weighed.join(starts, key).withColumn("_task", F.call_function("div", before, F.lit(share)).cast("int"))
    return placed.repartitionById(tasks, F.col("_task")).select(*files.columns)


def hash_files(files: DataFrame, digest: str = "md5") -> DataFrame:
    """Add ``hash`` and ``read_error`` by reading each file in pieces.

    For files beyond the 2 GiB a binary column can hold. Only paths and digests
    move; content is read once, inside the task. The files (``path, size, ...``)
    are spread over as many tasks as their content needs.
    """
    if digest not in DIGESTS:
        raise ValueError(f"digest must be one of {DIGESTS}")
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = spread_by_content(files, at_least=width)

    def digest_of(batches):
        import hashlib

        for batch in batches:
            hashes, problems = [], []
            for path in batch["path"]:
                try:
                    state = hashlib.new(digest)
                    with storage.open_content(path) as content:
                        while piece := content.read(1 << 20):
                            state.update(piece)
                    hashes.append(state.hexdigest())
                    problems.append(None)
                except OSError as problem:
                    hashes.append(None)
                    problems.append(storage.reason(problem))
            yield batch.assign(hash=hashes, read_error=problems)

    files = files.drop("hash", "read_error")
    added = [T.StructField(name, T.StringType()) for name in ("hash", "read_error")]
    return files.mapInPandas(digest_of, T.StructType(files.schema.fields + added))


def dest_listing(inventory: DataFrame) -> DataFrame:
    """Keys taken at the destination, from a listing or a payload table."""
    key = "dest_path" if "dest_path" in inventory.columns else "path"
    return inventory.select(F.col(key).alias("dest_path")).distinct()


def taken_keys(spark: SparkSession, payload_table: str) -> DataFrame:
    """Keys taken in a payload table, none if it was never written."""
    try:
        return dest_listing(spark.read.parquet(payload_table))
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in (problem.getCondition() or ""):
            raise
        return spark.createDataFrame([], "dest_path string")
