"""Session setup and the one place where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Message copies are merged in hash maps of this many keys before sorting takes over.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384",
    # A file is one row, so Arrow batches are bounded by their bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
}


def build_session(app: str = "threadlake", master: str | None = None, **settings) -> SparkSession:
    """A session with the settings the engine expects; dots in names become ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may run without the setting; it then gets a temporary
    folder of its own, because driver and executors are the same machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def run_folder(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{shared_folder(spark).rstrip('/')}/threadlake-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives the loss of executors, and leaves a columnar
    table, so later readers load just the columns they use and the planner
    knows its size.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_intermediate(spark: SparkSession) -> None:
    """Delete this application's intermediate tables once its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(path, True)
