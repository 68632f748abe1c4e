"""Tag metadata: nested container JSON to the tall ``tags`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold import schemas


def flatten_tags(metadata: DataFrame) -> DataFrame:
    """``(path, metadata)`` to ``(path, scope, tag, stream_index, value)``.

    One pass: each document becomes one array of tag rows, exploded in place, so
    nothing is shuffled. Tags of the container have stream index -1.
    """
    doc = F.from_json("metadata", schemas.CONTAINER)

    def rows(scope, index, tags):
        return F.transform(
            F.map_entries(tags),
            lambda tag: F.struct(
                F.lit(scope).alias("scope"),
                tag["key"].alias("tag"),
                index.cast("int").alias("stream_index"),
                tag["value"].alias("value"),
            ),
        )

    container = rows("format", F.lit(-1), F.col("doc.format.tags"))
    streams = F.flatten(
        F.filter(
            F.transform(
                "doc.streams", lambda stream, at: rows("stream", at, stream["tags"])
            ),
            lambda tags: tags.isNotNull(),
        )
    )
    empty = F.array().cast(
        "array<struct<scope:string,tag:string,stream_index:int,value:string>>"
    )
    both = F.concat(F.coalesce(container, empty), F.coalesce(streams, empty))
    return (
        metadata.select("path", doc.alias("doc"))
        .select("path", F.explode(both).alias("row"))
        .select("path", "row.*")
    )
