"""A deterministic sharded WARC writer, and its reader.

Records are dealt by ranges of page_id and sorted within; each range writes its
own files, which roll once ``roll_bytes`` of compressed records are in one. Ranges
are as many as ``SHARD_BYTES`` of payload ask for, so a task's work does not grow
with the table; rows without an id, or of one id that is heavier than that, are cut
by their digests as well. Each record is a gzip member of its own. Headers, record
ids and digests are made anew from the rows, so that every run and every retried
task writes the same bytes.

Files are written under temporary names that no other attempt and no other writer
has. The names that finished tasks report are the manifest; a second job over it
moves each file to its final name. A move that finds the name taken compares what
lies there by size and SHA-256: the same content is the work of an earlier attempt
or run, and other content is never kept in silence, but replaced (``replace=True``)
or an error. Once all files are in place the manifest is written beside them, in
shards below ``.manifest`` and then a file ``MANIFEST`` there that names them; archives
are read by a manifest, and every file is checked against it. Replacing writers
take the names of an earlier manifest that they do not use out of the folder.

Of equal payloads the one of smallest page_id is stored, the others refer to it.
Which page a payload refers to is worked out on digests alone and reaches the
writer as small rows that sort before the page's own, so payloads are shuffled
once. Equal payloads, however many, are one row per page there.

The folder must be of a kind that pyarrow's file systems open (local mounts,
HDFS, S3 and the like).

Defined results: null html is an empty payload; a null url leaves its header out
(control characters in one are percent-encoded); rows without page_id sort last
and are never referred to, so that equal payloads that have no id at all are all
stored; of rows that repeat a page_id and payload the first is stored; an empty
table writes no archive and gives no rows; other columns are not looked at. A folder
whose write did not end has no ``MANIFEST`` (or still that of before, whose files
may then fail their check); writing again completes it. Of two writers with
different rows the one that meets the other's file fails.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import scratch_of, whole_batches
from tidefold.llm.ranges import shard_bounds, shard_of

ROLL_BYTES = 64 << 20
# Payload of one range, which is one task's work.
SHARD_BYTES = 256 << 20
MIN_REVISIT_BYTES = 0
# Equal runs write equal bytes, so the date is that of the data and not of the run.
DATE = "2000-01-01T00:00:00Z"
PREFIX = "pages"
READ_BYTES = 1 << 20
BLOCK_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "name string, temporary string, bytes long, records long, sha256 string"
FILES = "name string, bytes long, records long, sha256 string"
# The file that commits a folder, and the shards of the manifest it names.
COMMIT, SHARD = ".manifest/MANIFEST", ".manifest/part-{:05d}.jsonl"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def sha1_label(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, turn: int) -> str:
    name = f"{page_id}:{digest}:{turn}"
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(name.encode()).digest()[:16], version=4)}>"


def _record(kind: str, headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *headers]
    lines += [("WARC-Block-Digest", f"sha1:{sha1_label(block)}"), ("Content-Length", len(block))]
    head = "".join(f"{name}: {value}\r\n" for name, value in lines if value is not None)
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = b"WARC/1.1\r\n" + head.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"
    return member.compress(whole) + member.flush()


def page_record(page_id, url, payload: bytes, turn: int, refers_to) -> bytes:
    """A response, or a revisit where ``refers_to`` is given."""
    digest = sha1_label(payload)
    target = None if url is None else _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    headers = [
        ("WARC-Record-ID", record_id(page_id, digest, turn)),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", page_id),
    ]
    if refers_to is None:
        return _record("response", headers, http.encode() + payload)
    headers += [
        ("WARC-Profile", PROFILE),
        ("WARC-Refers-To", record_id(refers_to, digest, 0)),
        ("X-Refers-To-Page-ID", refers_to),
    ]
    return _record("revisit", headers, http.encode())


def _info(name: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    headers = [
        ("WARC-Record-ID", record_id(None, name, 0)),
        ("WARC-Filename", name),
        ("Content-Type", "application/warc-fields"),
    ]
    return _record("warcinfo", headers, block)


class _Roll:
    """The files of one range: rolled by compressed size, under temporary names."""

    def __init__(self, folder: str, temporary: str, shard: int, roll_bytes: int):
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.below = temporary
        self.shard, self.roll_bytes, self.turn = shard, roll_bytes, 0
        self.stream, self.done = None, []

    def add(self, member: bytes) -> None:
        if self.stream is not None and self.size + len(member) > self.roll_bytes:
            self.close()
        if self.stream is None:
            self.name = f"{PREFIX}-{self.shard:06d}-{self.turn:05d}.warc.gz"
            self.temporary = f"{self.below}/{self.name}.{uuid.uuid4().hex}"
            self.stream = self.system.open_output_stream(posixpath.join(self.folder, self.temporary), compression=None)
            self.turn, self.size, self.records, self.hash = self.turn + 1, 0, 0, hashlib.sha256()
            self._put(_info(self.name))
        self._put(member)
        self.records += 1

    def _put(self, member: bytes) -> None:
        self.stream.write(member)
        self.hash.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None
            self.done.append((self.name, self.temporary, self.size, self.records, self.hash.hexdigest()))


def _writer(folder: str, temporary: str, roll_bytes: int, min_revisit_bytes: int):
    names = ["name", "temporary", "bytes", "records", "sha256"]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, key, turn, known, refers = None, None, 0, None, None
        fields = ("_shard", "page_id", "_digest", "_first", "url", "html")
        done = []
        for batch in whole_batches(batches, BLOCK_BYTES):
            rows = zip(*(batch.column(name).to_pylist() for name in fields), batch.column("_page").to_pylist())
            for shard, page_id, digest, first, url, html, is_page in rows:
                if not is_page:
                    known, refers = (page_id, digest), first
                    continue
                if roll is None or roll.shard != shard:
                    if roll:
                        roll.close()
                        done += roll.done
                    roll = _Roll(folder, temporary, shard, roll_bytes)
                turn = turn + 1 if key == (page_id, digest) else 0
                key = (page_id, digest)
                payload = (html or "").encode("utf-8")
                to = refers if known == key and len(payload) >= min_revisit_bytes else None
                if to is not None and to == page_id and turn == 0:
                    to = None
                roll.add(page_record(page_id, url, payload, turn, to))
        if roll:
            roll.close()
            done += roll.done
        if done:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*done), types)), names)

    return write


def _sha256_of(system, path: str) -> str:
    state = hashlib.sha256()
    with system.open_input_stream(path, compression=None) as stream:
        while piece := stream.read(READ_BYTES):
            state.update(piece)
    return state.hexdigest()


def _place(system, temporary: str, final: str, size: int, sha256: str, replace: bool) -> None:
    """Move a file to its name; what lies there stays only if it is the same."""
    there = system.get_file_info(final)
    if there.type != fs.FileType.NotFound:
        if there.size == size and _sha256_of(system, final) == sha256:
            return
        if not replace:
            raise FileExistsError(f"{final} holds other content; replace it, or write to another folder")
        system.delete_file(final)
    system.move(temporary, final)


def _mover(folder: str, replace: bool):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary, size, _, sha256 in zip(*(column.to_pylist() for column in batch.columns)):
                _place(system, posixpath.join(root, temporary), posixpath.join(root, name), size, sha256, replace)
            yield batch

    return move


def _manifest_writer(folder: str, temporary: str):
    """Writes each shard of the manifest under its name; yields name and checksum."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        lines: dict[int, list[str]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                shard = row.pop("_part")
                lines.setdefault(shard, []).append(json.dumps(row, sort_keys=True))
        for shard, own in lines.items():
            data = "".join(f"{line}\n" for line in sorted(own)).encode()
            name, draft = SHARD.format(shard), posixpath.join(root, temporary, uuid.uuid4().hex)
            with system.open_output_stream(draft, compression=None) as stream:
                stream.write(data)
            sha256 = hashlib.sha256(data).hexdigest()
            _place(system, draft, posixpath.join(root, name), len(data), sha256, True)
            yield pa.RecordBatch.from_pydict({"name": [name], "sha256": [sha256]})

    return write


def _remover(folder: str):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                if system.get_file_info(posixpath.join(root, name)).type != fs.FileType.NotFound:
                    system.delete_file(posixpath.join(root, name))
            yield batch

    return remove


def _commit(files: DataFrame, folder: str, temporary: str, scratch) -> None:
    """Write the manifest beside the files, and the file that names its shards last."""
    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("*", F.pmod(F.xxhash64("name"), F.lit(width)).cast("int").alias("_part")).repartition(width, "_part")
    parts = scratch.save(dealt.mapInArrow(_manifest_writer(folder, temporary), "name string, sha256 string"), "manifest-parts")
    # A row per shard.
    listed = sorted(map(tuple, parts.collect()))
    system, root = fs.FileSystem.from_uri(folder)
    draft = posixpath.join(root, temporary, posixpath.basename(COMMIT))
    with system.open_output_stream(draft, compression=None) as stream:
        stream.write(json.dumps({"shards": listed}).encode())
    final = posixpath.join(root, COMMIT)
    if system.get_file_info(final).type != fs.FileType.NotFound:
        system.delete_file(final)
    system.move(draft, final)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """``name, bytes, records, sha256`` of a folder's archives; None where no write was committed."""
    system, root = fs.FileSystem.from_uri(folder)
    final = posixpath.join(root, COMMIT)
    if system.get_file_info(final).type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(final, compression=None) as stream:
        shards = json.loads(stream.read())["shards"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, sha256 in zip(*(column.to_pylist() for column in batch.columns)):
                with system.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                    data = stream.read()
                if hashlib.sha256(data).hexdigest() != sha256:
                    raise ValueError(f"{name} is not the manifest that {COMMIT} names")
                yield pa.RecordBatch.from_pylist([json.loads(line) for line in data.splitlines()]).select(
                    [field.split()[0] for field in FILES.split(", ")]
                )

    named = spark.createDataFrame([tuple(shard) for shard in shards], "name string, sha256 string")
    return named.mapInArrow(read, FILES)


def _places(rows: DataFrame, width: int) -> tuple[Column, int]:
    """The range of each row (``page_id, _digest, _bytes``) and how many there are.

    Ids that are heavier than a range, of which there are fewer than ranges, are cut by digest;
    rows without an id are one more such id, behind all others.
    """
    weights = rows.groupBy("page_id").agg(F.sum("_bytes").alias("_bytes"))
    heavy = {row["page_id"]: row["_bytes"] for row in weights.where(F.col("_bytes") > SHARD_BYTES).collect()}
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    bounds = shard_bounds(rows, "page_id", max(width, ceil(total / SHARD_BYTES)))
    none = len(bounds) + 1
    place, last = F.when(F.col("page_id").isNull(), none).otherwise(shard_of("page_id", bounds)), none + 1
    for page_id, size in sorted(heavy.items(), key=lambda item: (item[0] is None, item[0])):
        parts = ceil(size / SHARD_BYTES)
        own = F.pmod(F.xxhash64("_digest"), F.lit(parts)).cast("int") + last
        place = F.when(F.col("page_id").eqNullSafe(F.lit(page_id).cast("long")), own).otherwise(place)
        last += parts
    return place, last


def write_archives(
    pages: DataFrame,
    folder: str,
    roll_bytes: int = ROLL_BYTES,
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
    scratch=None,
    replace: bool = False,
) -> DataFrame:
    """Write ``pages`` below ``folder`` and return the manifest, one row per file."""
    spark = pages.sparkSession
    scratch = scratch or scratch_of(pages)
    system, root = fs.FileSystem.from_uri(folder)
    temporary = f".temporary/{uuid.uuid4().hex}"
    for name in (temporary, posixpath.dirname(COMMIT)):
        system.create_dir(posixpath.join(root, name), recursive=True)
    # Read now: its shards are written over below.
    before = read_manifest(spark, folder) if replace else None
    before = before and scratch.save(before, "before")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.sha1(F.encode(html, "utf-8")).alias("_digest"))
    ids = scratch.save(rows.select("page_id", "_digest", F.octet_length(html).cast("long").alias("_bytes")), "digests")
    place, shards = _places(ids, width)
    shared = (
        ids.groupBy("_digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .where((F.col("_rows") > 1) & F.col("_first").isNotNull())
        .drop("_rows")
    )
    none = F.lit(None)
    notes = ids.join(shared, "_digest").select(
        "page_id", none.cast("string").alias("url"), none.cast("string").alias("html"), "_digest", "_first",
        F.lit(False).alias("_page"),
    )
    dealt = (
        rows.select("page_id", "url", "html", "_digest", none.cast("long").alias("_first"), F.lit(True).alias("_page"))
        .unionByName(notes)
        .withColumn("_shard", place)
        .repartitionById(shards, F.col("_shard"))
        .sortWithinPartitions("_shard", F.col("page_id").asc_nulls_last(), "_digest", "_page", "url")
    )
    written = scratch.save(dealt.mapInArrow(_writer(folder, temporary, roll_bytes, min_revisit_bytes), MANIFEST), "written")
    moved = scratch.save(written.repartition(width, "name").mapInArrow(_mover(folder, replace), MANIFEST), "moved")
    files = moved.drop("temporary")
    _commit(files, folder, temporary, scratch)
    if before is not None:
        stale = before.join(files.select("name"), "name", "left_anti").select("name")
        scratch.save(stale.repartition(width).mapInArrow(_remover(folder), "name string"), "removed")
    system.delete_dir(posixpath.join(root, temporary))
    return files


def parse_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open gzip stream."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins here: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            headers[name] = value
        size = int(headers["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{headers.get('WARC-Record-ID')} is cut off")
        if headers["WARC-Block-Digest"] != f"sha1:{sha1_label(block)}":
            raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
        yield headers, block


def _reader(folder: str):
    names = [part.split()[0] for part in RECORDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def row(headers: dict[str, str], block: bytes):
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if headers["WARC-Type"] == "response" and (len(payload) != size or sha1_label(payload) != digest):
            raise ValueError(f"{headers['WARC-Record-ID']} has another payload")
        number = lambda name: int(headers[name]) if name in headers else None
        return (
            number("X-Page-ID"), headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"],
            number("X-Refers-To-Page-ID"),
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size, sha256 in zip(*(column.to_pylist() for column in batch.columns)):
                rows = []
                with system.open_input_stream(posixpath.join(root, name), compression=None, buffer_size=READ_BYTES) as raw:
                    checked = _Checked(raw)
                    with gzip.GzipFile(fileobj=checked) as stream:
                        for headers, block in parse_archive(stream):
                            if headers["WARC-Type"] != "warcinfo":
                                rows.append(row(headers, block))
                            if len(rows) == 10_000:
                                yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), types)), names)
                                rows = []
                    if (checked.size, checked.state.hexdigest()) != (size, sha256):
                        raise ValueError(f"{name} is not the file that the manifest names")
                if rows:
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*rows), types)), names)

    return read


class _Checked(io.RawIOBase):
    """A stream that keeps size and SHA-256 of what was read of it."""

    def __init__(self, stream):
        self.stream, self.size, self.state = stream, 0, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def read(self, most: int = -1) -> bytes:
        piece = self.stream.read(most) if most >= 0 else self.stream.read()
        self.size += len(piece)
        self.state.update(piece)
        return piece


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the files that ``manifest`` names; files and records are checked."""
    width = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("name", "bytes", "sha256")
    return files.repartition(width, "name").mapInArrow(_reader(folder), RECORDS)
