"""Per-tile minimum/maximum tables in CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def stats_schema(band: str) -> str:
    key = "name" if band == "ndvi" else "tile_id"
    return f"{key} STRING, {band}_min DOUBLE, {band}_max DOUBLE"


def read_stats_csv(spark: SparkSession, directory: str, band: str, schema: str | None = None) -> DataFrame:
    """The first CSV (by name) whose file name contains the band; the key column is always ``tile_id``."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"*{band}*.csv").load(directory).select("path")
    first = names.orderBy("path").limit(1).collect()
    if not first:
        raise FileNotFoundError(f"no CSV for band {band} in {directory}")
    df = spark.read.schema(schema or stats_schema(band)).option("header", True).option(
        "enforceSchema", False).csv(first[0]["path"])
    return df.withColumnRenamed("name", "tile_id")


def write_stats_csv(df: DataFrame, path: str, parts: int = 1) -> None:
    """Header CSV in ``parts`` files; every row is kept."""
    df.repartition(parts).write.mode("overwrite").option("header", True).csv(path)
