"""The journal of runs: what each planned, what landed, and what is due again.

A run passes three states, each a row of ``states`` appended once all before it is
committed. *planned*: the rows it is going to copy, and the paths due again whatever
becomes of them, are written down. *written*: the payload is committed and the keys
that landed are written down. *recorded*: the ledger has them. A run that dies
anywhere leaves enough behind for the next to complete it, and nothing is ever read
but the tables of the runs in question.

Below the journal's folder: ``states`` (run, state, as_of), and a table per run of
``planned``, ``landed``, ``due`` and, where asked for, ``snapshot``.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PLANNED, WRITTEN, RECORDED = STATES = ("planned", "written", "recorded")

STATE_ROW = "run string, state string, as_of timestamp"
PLANNED_ROW = (
    "path string, dest_path string, month string, hash string, size bigint, mtime timestamp, copied_at timestamp"
)
LANDED_ROW = "dest_path string"
# ``kind`` tells a file from a folder that could not be listed.
DUE_ROW = "path string, kind string, reason string"

FILE, FOLDER = "file", "folder"


def read_or_empty(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    """A parquet table, empty if nothing was ever written.

    Without a schema the files tell it; where none was committed there is only a key.
    """
    reader = spark.read.schema(schema) if schema else spark.read
    try:
        return reader.parquet(path)
    except AnalysisException as problem:
        if not {"PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"} & {problem.getCondition()}:
            raise
        return spark.createDataFrame([], schema or LANDED_ROW)


def furthest_states(states: DataFrame) -> DataFrame:
    """``run, as_of, state``: the last state each run has reached."""
    rank = F.array_position(F.array(*map(F.lit, STATES)), F.col("state"))
    return states.groupBy("run").agg(
        F.max("as_of").alias("as_of"), F.max_by("state", rank).alias("state")
    )


class Journal:
    """The journal kept in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def new_run(self, as_of: datetime) -> str:
        """A name no other run has; names sort by time."""
        return f"{as_of.astimezone(timezone.utc):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:12]}"

    def write(self, kind: str, run: str, rows: DataFrame) -> None:
        """A run's table of one kind, in place of what a died attempt left of it."""
        rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/run={run}")

    def read(self, kind: str, run: str, schema: str) -> DataFrame:
        return read_or_empty(self.spark, f"{self.folder}/{kind}/run={run}", schema)

    def mark(self, run: str, state: str, as_of: datetime) -> None:
        row = self.spark.createDataFrame([(run, state, as_of)], STATE_ROW).coalesce(1)
        row.write.mode("append").parquet(f"{self.folder}/states")

    def states(self) -> DataFrame:
        return furthest_states(read_or_empty(self.spark, f"{self.folder}/states", STATE_ROW))

    def unfinished(self) -> list[tuple[str, str, datetime]]:
        """Runs that died, in order: as many as died since the last that did not."""
        open_runs = self.states().where(F.col("state") != RECORDED).orderBy("as_of", "run")
        return [(row["run"], row["state"], row["as_of"]) for row in open_runs.collect()]

    def last(self, kind: str, schema: str) -> DataFrame | None:
        """The table of one kind that the last recorded run has left, None if none has."""
        recorded = self.states().where(F.col("state") == RECORDED)
        last = recorded.agg(F.max(F.struct("as_of", "run")).alias("last")).first()["last"]
        return last and self.read(kind, last["run"], schema)

    def due(self) -> DataFrame:
        """Paths due again after the last recorded run, whatever their age."""
        left = self.last("due", DUE_ROW)
        return self.spark.createDataFrame([], DUE_ROW) if left is None else left

    def taken(self) -> DataFrame:
        """Destinations of all that ever landed; content is no part of these tables."""
        landed = read_or_empty(self.spark, f"{self.folder}/landed", LANDED_ROW + ", run string")
        return landed.select("dest_path").distinct()
