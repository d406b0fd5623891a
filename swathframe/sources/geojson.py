"""Zones and tile grids in GeoJSON, zones as WKT lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathframe.functions.common import as_col
from swathframe.functions.geometry import bounds, outer_ring

_SCHEMA = ("features ARRAY<STRUCT<properties: MAP<STRING, STRING>, "
           "geometry: STRUCT<type: STRING, coordinates: ARRAY<ARRAY<ARRAY<DOUBLE>>>>>>")


def _features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).option("multiLine", True).json(path)


def read_geojson_zone(spark: SparkSession, path: str) -> DataFrame:
    """One zone: its outer ring and bounding box; fails unless the file has exactly one feature."""
    one = F.when(F.size("features") == 1, F.get("features", F.lit(0))).otherwise(F.raise_error(F.format_string(
        "a zone file needs one feature, found %d", F.size("features"))).cast(_element_type()))
    return _features(spark, path).select(one.alias("f")).select(
        outer_ring("f.geometry.coordinates").alias("ring")).select("ring", bounds("ring").alias("bbox"))


def _element_type() -> str:
    return _SCHEMA.split("ARRAY<", 1)[1][:-1]


def read_tile_grid(spark: SparkSession, path: str) -> DataFrame:
    """(location, ring) of every grid feature; empty locations or rings fail."""
    feats = _features(spark, path).select(F.explode("features").alias("f"))
    location, coords = F.col("f.properties")["location"], F.col("f.geometry.coordinates")
    return feats.select(
        F.coalesce(location, F.raise_error(F.lit("grid feature without location")).cast("string")).alias("location"),
        F.when(F.size(coords) > 0, outer_ring(coords)).otherwise(F.raise_error(
            F.lit("grid feature without coordinates")).cast("array<struct<lon:double,lat:double>>")).alias("ring"))


def polygon_wkt(coordinates) -> Column:
    """WKT of GeoJSON polygon coordinates, all rings."""
    def number(v):
        return F.regexp_replace(v.cast("string"), "\\.0$", "")

    rings = F.transform(as_col(coordinates), lambda ring: F.concat(F.lit("("), F.array_join(F.transform(
        ring, lambda p: F.concat_ws(" ", number(p[0]), number(p[1]))), ", "), F.lit(")")))
    return F.concat(F.lit("POLYGON ("), F.array_join(rings, ", "), F.lit(")"))


def zones_to_wkt(spark: SparkSession, path: str) -> DataFrame:
    """One WKT line per polygon feature, in file order."""
    return _features(spark, path).select(F.posexplode("features").alias("pos", "f")).orderBy("pos").select(
        polygon_wkt("f.geometry.coordinates").alias("value"))


def write_wkt(zones: DataFrame, path: str) -> None:
    zones.select("value").write.mode("overwrite").text(path)
