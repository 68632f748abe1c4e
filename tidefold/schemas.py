"""Table schemas shared by the operators."""

from pyspark.sql import types as T

INVENTORY = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("size", T.LongType()),
])

SCAN_ERRORS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("message", T.StringType()),
])

LEDGER = T.StructType([
    T.StructField("src_path", T.StringType()),
    T.StructField("dest_path", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("copied_at", T.TimestampType()),
])

TAGS = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("tag", T.StringType()),
    T.StructField("stream_index", T.IntegerType()),
    T.StructField("value", T.StringType()),
])

_TAG_MAP = T.MapType(T.StringType(), T.StringType())

# Container metadata as JSON: tags of the file as a whole and of each stream.
CONTAINER = T.StructType([
    T.StructField("format", T.StructType([T.StructField("tags", _TAG_MAP)])),
    T.StructField(
        "streams", T.ArrayType(T.StructType([T.StructField("tags", _TAG_MAP)]))
    ),
])
