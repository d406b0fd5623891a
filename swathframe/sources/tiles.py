"""Tile files and tile data sets."""

from __future__ import annotations

import re
from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CHUNKS = "path string, tile_id string, band string, n_rows int, n_cols int, values array<double>"


def glob_literal(path: str) -> str:
    """The path as a pattern that matches only itself."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def read_npy_tiles(spark: SparkSession, path: str, limit: int | None = None, bands=None) -> DataFrame:
    """``*.npy`` arrays (rows, cols[, channels]) of a directory as one row per tile and band.

    Files are taken in path order up to ``limit``.  All must have the shape of
    the first one; another shape fails in the task that meets it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)
    if limit is not None:
        # Choose by name only: file contents never pass through the sort.
        files = files.join(files.select("path").orderBy("path").limit(limit), "path", "left_semi")
    first = files.agg(F.min("path").alias("path")).first()["path"]
    if first is None:
        raise FileNotFoundError(f"no .npy files under {path}")
    content = spark.read.format("binaryFile").load(glob_literal(first)).select("content").first()["content"]
    shape = np.load(BytesIO(content)).shape
    names = list(bands) if bands else None

    def parse(batches):
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"]):
                rows = []
                array = np.load(BytesIO(content))
                if array.shape != shape:
                    raise ValueError(f"{file}: shape {array.shape}, expected {shape}")
                cube = array[:, :, None] if array.ndim == 2 else array
                tile = file.rsplit("/", 1)[-1].removesuffix(".npy")
                for b in range(cube.shape[2]):
                    rows.append((file, tile, names[b] if names else f"b{b}", cube.shape[0], cube.shape[1],
                                 cube[:, :, b].astype(float).ravel()))
                yield pd.DataFrame(rows, columns=["path", "tile_id", "band", "n_rows", "n_cols", "values"])

    return files.select("path", "content").mapInPandas(parse, _CHUNKS)


def write_tiles(df: DataFrame, path: str, partitions=("split", "role"), mode: str = "overwrite") -> None:
    """Partitioned tile data set (split=/role=/...)."""
    df.write.mode(mode).partitionBy(*partitions).parquet(path)


def layout_columns(df: DataFrame, role: str, sensor: int, t: int, split: str | None = None) -> DataFrame:
    """Directory levels of the data-set layout as partition columns."""
    out = df.withColumn("role", F.lit(role)).withColumn("sensor", F.lit(sensor)).withColumn("t", F.lit(t))
    return out if split is None else out.withColumn("split", F.lit(split))


def is_complete(spark: SparkSession, path: str) -> bool:
    """A finished write left its success marker; a directory alone may be a lost job's remains."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialize_once(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` unless a complete copy exists, then read it back."""
    spark = df.sparkSession
    if not is_complete(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
