"""A digest of large contents made of many tasks' work: a tree of hashes over fixed parts.

Content is cut into parts of ``part_bytes`` (an empty one is one empty part). A leaf is the
SHA-256 of ``l`` and the part. While there is more than one digest, each ``fan`` of them in
a row are replaced by the SHA-256 of ``n`` and their hex digests in order; the last one left
is the digest of the content. It depends on the content, ``part_bytes`` and ``fan`` alone.

A file of a hundred parts is a hundred units of work, dealt to tasks by the bytes they read.
A level of the tree is one combined aggregation over groups of ``fan`` rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidefold.sources import storage
from tidefold.sources.listing import spread_by_content

PART_BYTES = 32 << 20
FAN = 1024
LEAF, NODE = "l", "n"

CHANGED = "content changed since it was listed"


def leaf_digest(part: Column) -> Column:
    """Of a binary column."""
    return F.sha2(F.concat(F.lit(LEAF.encode()), part), 256)


def combine(leaves: DataFrame, key: str, most_parts: int, fan: int = FAN) -> DataFrame:
    """``key, hash`` from ``key, part, digest``; ``most_parts`` is the largest number of parts of a key.

    A key one of whose digests is null gets a null hash.
    """
    level, width = leaves.select(key, "part", "digest"), most_parts
    while width > 1:
        inside = F.array_sort(F.collect_list(F.struct("part", F.coalesce("digest", F.lit("")).alias("digest"))))
        joined = F.concat(F.lit(NODE), F.array_join(F.transform("_inside", lambda one: one["digest"]), ""))
        whole = ~F.exists("_inside", lambda one: one["digest"] == "")
        # A key that is down to one digest keeps it.
        single = (F.col("_group") == 0) & (F.size("_inside") == 1)
        only = F.get("_inside", F.lit(0))["digest"]
        level = (
            level.groupBy(key, F.call_function("div", F.col("part"), F.lit(fan).cast("bigint")).alias("_group"))
            .agg(inside.alias("_inside"))
            .select(key, F.col("_group").alias("part"), F.when(whole, F.when(single, only).otherwise(F.sha2(joined, 256))).alias("digest"))
        )
        width = -(-width // fan)
    return level.select(key, F.col("digest").alias("hash"))


def cut(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Parts of files (``path, size``): ``path, part, offset, length, last``."""
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / part_bytes)).cast("bigint")
    return files.select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)).alias("part"), count.alias("_parts")
    ).select(
        "path",
        "part",
        (F.col("part") * part_bytes).alias("offset"),
        F.least(F.lit(part_bytes), F.col("size") - F.col("part") * part_bytes).alias("length"),
        (F.col("part") == F.col("_parts") - 1).alias("last"),
    )


def hash_parts(parts: DataFrame) -> DataFrame:
    """``path, part, digest, read_error``: each part read by the task that gets it."""
    fields = ["path", "part", "digest", "read_error"]

    def digest_of(batches):
        import hashlib

        import pandas as pd

        def read(path, offset, length, last):
            state, left = hashlib.sha256(LEAF.encode()), length
            with storage.open_at(path, offset) as content:
                while left and (piece := content.read(min(left, 1 << 20))):
                    state.update(piece)
                    left -= len(piece)
                if left or (last and content.read(1)):
                    raise OSError(None, CHANGED)
            return state.hexdigest()

        for batch in batches:
            rows = []
            for path, part, offset, length, last in zip(*(batch[c] for c in ("_file", "part", "offset", "length", "last"))):
                try:
                    rows.append((path, part, read(path, offset, length, last), None))
                except OSError as problem:
                    rows.append((path, part, None, storage.reason(problem)))
            yield pd.DataFrame(rows, columns=fields)

    width = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Each part is a file of its own to what deals them out.
    units = parts.withColumnRenamed("path", "_file").withColumns({
        "path": F.concat("_file", F.lit("\n"), "part"), "size": F.col("length"),
    })
    kinds = (T.StringType(), T.LongType(), T.StringType(), T.StringType())
    schema = T.StructType([T.StructField(name, kind) for name, kind in zip(fields, kinds)])
    return spread_by_content(units, at_least=width).mapInPandas(digest_of, schema)


def tree_hash_files(files: DataFrame, part_bytes: int = PART_BYTES, fan: int = FAN) -> DataFrame:
    """``path, hash, read_error`` of files (``path, size``, a path once); a file that fails anywhere has no hash."""
    sized = files.select("path", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    largest = sized.agg(F.max("size")).first()[0] or 0
    hashed = hash_parts(cut(sized, part_bytes))
    problems = hashed.groupBy("path").agg(F.min("read_error").alias("read_error"))
    return combine(hashed, "path", max(1, -(-largest // part_bytes)), fan).join(problems, "path")


def tree_hash(rows: DataFrame, key: str, content: str, part_bytes: int = PART_BYTES, fan: int = FAN) -> DataFrame:
    """``key, hash`` of a text or binary column, a key once; null content has no row."""
    binary = rows.where(F.col(content).isNotNull()).select(key, F.col(content).cast("binary").alias("_content"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("_content") / part_bytes)).cast("int")
    most = binary.agg(F.max(count)).first()[0] or 1

    def digest(part: Column) -> Column:
        return leaf_digest(F.substring("_content", part * part_bytes + 1, F.lit(part_bytes)))

    digests = F.transform(F.sequence(F.lit(0), count - 1), digest)
    leaves = binary.select(key, F.posexplode(digests).alias("part", "digest"))
    return combine(leaves.withColumn("part", F.col("part").cast("bigint")), key, most, fan)
