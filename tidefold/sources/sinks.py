"""Tables a run writes: payload by month, and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.functions.states import COPIED
from tidefold.operators.recovery import landed_keys
from tidefold.sources.journal import read_or_empty
from tidefold.sources.listing import spread_by_content
from tidefold.sources.storage import open_content

ACCEPTED = ("path", "dest_path", "month", "hash", "size", "mtime")

# Content of a file travels in parts of at most this many bytes.
PART_BYTES = 32 * 1024 * 1024


def accepted(results: DataFrame) -> DataFrame:
    return results.where(F.col("state") == COPIED).select(*ACCEPTED)


def accepted_payload(results: DataFrame, payload: DataFrame) -> DataFrame:
    """Payload columns of the copied rows, one row each, from a table joined on ``path``.

    A path that the payload repeats is written once. Rows without payload are
    none of the copied ones: classification makes them copy errors.
    """
    return accepted(results).join(payload, "path").dropDuplicates(["path"])


def write_months(rows: DataFrame, folder: str) -> None:
    """Append rows under ``month=YYYY-MM``.

    The rebalance gives each task few months (hence few, large files) and splits
    a month too large for one task. The commit protocol makes the write atomic;
    mtime stays a column.
    """
    balanced = rows.hint("rebalance", "month")
    balanced.write.mode("append").partitionBy("month").parquet(folder)


def with_content(rows: DataFrame, part_bytes: int = PART_BYTES, digest: str = "md5") -> DataFrame:
    """Add ``part``, ``parts`` and ``content`` by reading each row's file in its task.

    A file of any size becomes as many rows as it has parts (one for an empty
    file), so neither a column limit nor memory bounds it. A file that cannot be
    read, or whose content no longer has the row's ``hash``, gives no row at all.
    A file of several parts is read twice, as its first part may only leave once
    the last is known to be good; should it change in between, the task fails,
    and its retry, which writes nothing twice, finds the file changed.
    """

    def read(batches):
        import hashlib

        def pieces(path):
            with open_content(path) as source:
                piece = source.read(part_bytes)
                yield piece
                while piece := source.read(part_bytes):
                    yield piece

        def good_pieces(path, wanted):
            try:
                state, count = hashlib.new(digest), 0
                for piece in pieces(path):
                    state.update(piece)
                    count += 1
            except OSError:
                return
            if isinstance(wanted, str) and state.hexdigest() != wanted:
                return
            if count == 1:
                yield count, piece
                return
            again = hashlib.new(digest)
            for piece in pieces(path):
                again.update(piece)
                yield count, piece
            if again.digest() != state.digest():
                raise OSError(f"{path} changed while it was copied")

        for batch in batches:
            at, parts, counts, contents, held = [], [], [], [], 0
            hashes = batch["hash"] if "hash" in batch else [None] * len(batch)
            for position, (path, wanted) in enumerate(zip(batch["path"], hashes)):
                for part, (count, content) in enumerate(good_pieces(path, wanted)):
                    at.append(position)
                    parts.append(part)
                    counts.append(count)
                    contents.append(content)
                    held += len(content)
                    # Small files leave together, a large one in pieces.
                    if held >= part_bytes:
                        yield batch.iloc[at].assign(part=parts, parts=counts, content=contents)
                        at, parts, counts, contents, held = [], [], [], [], 0
            if at:
                yield batch.iloc[at].assign(part=parts, parts=counts, content=contents)

    added = [T.StructField(name, T.LongType()) for name in ("part", "parts")]
    added.append(T.StructField("content", T.BinaryType()))
    return rows.mapInPandas(read, T.StructType(rows.schema.fields + added))


def write_files_by_month(results: DataFrame, folder: str, digest: str = "md5") -> DataFrame:
    """Write the content of the copied files under ``month=YYYY-MM`` of a run's own
    folder; return the accepted rows whose file could not be copied as it was hashed.

    Only the accepted rows are spread over tasks, by month and by the bytes
    they hold; content is read where it is written and never shuffled. What landed is
    read back from the run's folder alone, without its content.
    """
    rows = accepted(results)
    with_content(spread_by_content(rows, ("month",)), digest=digest).write.mode("append").partitionBy("month").parquet(folder)
    written = read_or_empty(rows.sparkSession, folder, "dest_path string, part bigint, parts bigint")
    return rows.join(landed_keys(written, True), "dest_path", "left_anti")


def write_report(rows: DataFrame, folder: str, form: str = "parquet") -> None:
    """Persist report rows (or the one-row summary) as parquet, json or csv."""
    writer = rows.write.mode("overwrite").format(form)
    if form == "csv":
        writer = writer.option("header", True)
    writer.save(folder)
