"""Session settings, and the shared folder that intermediate tables go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

SETTINGS = {
    # Months are cut in the session zone; fixing it keeps runs repeatable.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Lookups on a hot hash or destination are split even where the split
    # costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Where every partition of the smaller side is this small, by its measured
    # size, the join hashes it instead of sorting both sides by long paths.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    # A task holding a few months writes them side by side, without first
    # sorting the payload by month.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", app: str = "tidefold") -> SparkSession:
    """A single-JVM session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # No stack walk for every column expression that is built.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own: on a
    cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidefold-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


class Scratch:
    """Intermediate tables of one run, below the shared folder.

    A written table cuts the lineage for good (a lost executor loses nothing)
    and, unlike an RDD checkpoint, stays columnar and carries its real size, so
    later joins are planned on measured sizes.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/tidefold-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        target = f"{self.path}/{name}"
        df.write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def save_measured(self, df: DataFrame, name: str, *metrics) -> tuple[DataFrame, dict]:
        """Save, and measure aggregates on the way in the same job."""
        seen = Observation()
        saved = self.save(df.observe(seen, *metrics), name)
        return saved, seen.get

    def drop(self) -> None:
        """Delete the tables, once nothing made from them is needed any more."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        folder.getFileSystem(conf).delete(folder, True)
