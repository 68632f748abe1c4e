import os

DATA = "/root/testdata"


def sf(scale):
    return os.path.join(DATA, f"sf{scale}")


def values(df, *columns):
    """Rows as plain tuples, in the order given."""
    return [tuple(row) for row in df.select(*columns).collect()]


def apply(spark, function, inputs, kind="string"):
    """Map of input to output of a column function."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(value,) for value in inputs], f"v {kind}")
    return {row[0]: row[1] for row in df.select("v", function(F.col("v"))).collect()}


def sequential_placement(rows):
    """The one-worker loop that placement must equal: rows of
    ``(path, dest, hash)`` to ``{path: (state, existing)}``."""
    from tidefold.functions import states

    dests, hashes, outcome = set(), {}, {}
    for path, dest, digest in sorted(rows, key=lambda row: row[0].split("/")):
        if dest in dests:
            outcome[path] = (states.SKIPPED_DEST_EXISTS, None)
        elif digest in hashes:
            outcome[path] = (states.DUPLICATE, hashes[digest])
        else:
            dests.add(dest)
            hashes[digest] = dest
            outcome[path] = (states.COPIED, None)
    return outcome
