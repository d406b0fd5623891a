"""Catalogue answers (JSON features), archive inventory and url log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swathframe.functions.names import checksum_md5, zip_url

FEATURE_SCHEMA = ("properties STRUCT<title: STRING, quicklook: STRING, productIdentifier: STRING, cloudCover: DOUBLE, "
                  "services: STRUCT<download: STRUCT<url: STRING, size: BIGINT, checksum: STRING>>>")


def parse_features(df: DataFrame, json: str = "json") -> DataFrame:
    """Text column -> nested feature struct ``f``."""
    return df.withColumn("f", F.from_json(json, FEATURE_SCHEMA))


def flatten_catalogue_features(df: DataFrame, feature: str = "f", keep=()) -> DataFrame:
    """Flat row per feature: id, urls, digest, size, product and cloud cover."""
    p = F.col(f"{feature}.properties")
    download = p["services"]["download"]
    return df.select(*keep, p["title"].alias("image_id"), download["url"].alias("download_url"),
                     zip_url(p["quicklook"]).alias("zip_url"), checksum_md5(download["checksum"]).alias("md5"),
                     download["size"].alias("size"), p["productIdentifier"].alias("product_id"),
                     p["cloudCover"].alias("cloud_pct"))


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Stored answer pages (``{"features": [...]}``) as flat rows."""
    pages = spark.read.schema(f"features ARRAY<STRUCT<{FEATURE_SCHEMA.replace(' STRUCT', ': STRUCT', 1)}>>").option(
        "multiLine", True).json(path)
    return flatten_catalogue_features(pages.select(F.explode("features").alias("f")))


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Byte size and upper-case MD5 of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.upper(F.md5("content")).alias("md5"))


def append_url_log(urls: DataFrame, path: str, column: str = "url") -> None:
    urls.select(F.col(column).alias("value")).write.mode("append").text(path)
