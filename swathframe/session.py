"""Session settings the operators assume."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "swathframe", master: str | None = None, shuffle_partitions: int | None = None,
                  **extra) -> SparkSession:
    """Session with UTC time, adaptive execution and Arrow. On a cluster the partition count is left to AQE."""
    b = (SparkSession.builder.appName(name)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # Small local data: keep enough partitions after coalescing to use every core.
            b = b.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k").config(
                "spark.python.sql.dataFrameDebugging.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        b = b.config(key.replace("__", "."), str(value))
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster
    session without it fails, because a machine-local folder would lose data.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    return tempfile.mkdtemp(prefix="swathframe-")


def write_once(df: DataFrame) -> DataFrame:
    """Store an intermediate result that several plans read, and continue from the stored table.

    The table is columnar, so later plans read only their columns, and it
    survives the loss of executors.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
