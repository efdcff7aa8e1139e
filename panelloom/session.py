"""Session helpers: a local session for tests, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelloom")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


BATCH_ROWS = 2000
"""Rows of a batch that a Python worker gets, at most: it holds some copies of one, some of them as Python objects."""


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, with Arrow batches of at most ``BATCH_ROWS`` rows from here on; a smaller setting stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a temporary folder; on a
    cluster that would lose data with the machine, so it is an error there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="panelloom-"))
    return sc.getCheckpointDir().rstrip("/")


SCRATCH: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; never reused, so nothing is overwritten."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    SCRATCH.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the tables this process put into the shared folder: call it when their results have been read."""
    while SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written to the shared folder and read back.

    The frame is computed once and survives the loss of executors; later reads
    prune columns and know its size.
    """
    path = fresh_path(df.sparkSession, "durable")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
