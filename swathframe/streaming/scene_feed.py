"""New scene descriptions appended to the stored catalogue.

The batch operators make no ordering assumption, so each micro-batch goes
through the same functions as a full load.  The partition columns are those the
month pruning uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from swathframe.operators.scenes import with_partitions


def append_catalogue(stream: DataFrame, path: str, checkpoint: str, time: str = "start_time"):
    """Start a query that appends every batch once and stops when the present files are done.

    ``checkpoint`` must be on shared storage on a cluster: it is what lets a
    restarted query continue without loss or repetition.
    """
    return (with_partitions(stream, time).writeStream.format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).partitionBy("ym").trigger(availableNow=True).start())
