"""Scene-description XML: bulk read to ``scenes``, write back per satellite family."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathframe.constants import SCENE_XML_ROOT, SCENE_XML_TILE_SOURCE
from swathframe.functions.names import processing_level

# Attributes carry the reader's "_" prefix.
_SCHEMA = """
IDENTIFIER STRING, PATH STRING, INSTRUMENT STRING, PRODUCT_TYPE STRING, PROCESSING_LEVEL STRING,
SATELLITE STRUCT<_name: STRING, _text: STRING>,
CENTROID STRUCT<_longitude: DOUBLE, _latitude: DOUBLE, _text: STRING>,
ESA_CLOUD_COVER STRUCT<_percentage: INT, _text: STRING>,
ESA_TILEOUTLINE_FOOTPRINT_WKT STRING,
ACQUISITION_TIME STRUCT<_start_datetime_utc: STRING, _stop_datetime_utc: STRING, _datetime_utc: STRING, _text: STRING>,
ESA_PROCESSING STRUCT<_software_version: STRING, _processingtime_utc: STRING, _baselinecollection: STRING, _text: STRING>,
POLARISATION STRUCT<_values: STRING, _text: STRING>, SWATH STRUCT<_values: STRING, _text: STRING>,
MODE STRUCT<_value: STRING, _text: STRING>,
ORBIT_NUMBERS STRUCT<_relative: INT, _absolute: INT, _frame: INT, _cycle: INT, _text: STRING>,
PASS STRUCT<_direction: STRING, _text: STRING>,
ZIPFILE STRUCT<_size_bytes: BIGINT, _md5_local: STRING, _md5_esa: STRING, _text: STRING>,
MGRSTILES ARRAY<STRUCT<_source: STRING, _text: STRING>>
""".replace("\n", " ")


def _options(root: str) -> dict:
    return {"rowTag": root, "valueTag": "_text", "inferSchema": "false", "ignoreSurroundingSpaces": "true",
            "caseSensitive": "true"}


def _present(c: str) -> Column:
    """Empty attribute text counts as absent."""
    return F.when(F.length(c) > 0, F.col(c))


def _listed(c: str) -> Column:
    return F.split(c, ",")


def _scene_columns() -> list[Column]:
    start = F.coalesce(F.try_to_timestamp("ACQUISITION_TIME._start_datetime_utc", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")),
                       F.try_to_timestamp("ACQUISITION_TIME._datetime_utc", F.lit("yyyy-MM-dd HH:mm:ss")))
    stop = F.try_to_timestamp("ACQUISITION_TIME._stop_datetime_utc", F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    own = F.filter("MGRSTILES", lambda t: t["_source"] == SCENE_XML_TILE_SOURCE)
    tiles = F.transform(F.split(F.trim(F.regexp_replace(F.get(own, F.lit(0))["_text"], "^\\s+|\\s+$", "")), "\\s*\\n\\s*"),
                        lambda t: F.trim(t))
    return [
        F.col("IDENTIFIER").alias("scene_id"), F.col("SATELLITE._name").alias("satellite"),
        F.col("INSTRUMENT").alias("instrument"), F.col("PRODUCT_TYPE").alias("product_type"),
        F.col("PROCESSING_LEVEL").alias("processing_level"),
        F.col("CENTROID._longitude").alias("centroid_lon"), F.col("CENTROID._latitude").alias("centroid_lat"),
        F.col("ESA_CLOUD_COVER._percentage").alias("cloud_pct"), start.alias("start_time"), stop.alias("stop_time"),
        F.trim(F.regexp_replace("ESA_TILEOUTLINE_FOOTPRINT_WKT", "^\\s+|\\s+$", "")).alias("footprint_wkt"),
        _present("ESA_PROCESSING._software_version").alias("software_version"),
        F.col("ESA_PROCESSING._processingtime_utc").alias("processing_time"),
        _present("ESA_PROCESSING._baselinecollection").alias("baseline_collection"),
        _listed("POLARISATION._values").alias("polarisations"), _listed("SWATH._values").alias("swaths"),
        F.col("MODE._value").alias("mode"), F.col("ORBIT_NUMBERS._relative").alias("relative_orbit"),
        F.col("ORBIT_NUMBERS._absolute").alias("absolute_orbit"), F.col("ORBIT_NUMBERS._frame").alias("frame"),
        F.col("ORBIT_NUMBERS._cycle").alias("cycle"), F.col("PASS._direction").alias("pass_direction"),
        F.col("ZIPFILE._size_bytes").alias("size_bytes"), _present("ZIPFILE._md5_local").alias("md5_local"),
        _present("ZIPFILE._md5_esa").alias("md5_esa"), tiles.alias("mgrs_tiles")]


def read_scene_xml(spark: SparkSession, path: str, root: str = SCENE_XML_ROOT) -> DataFrame:
    """Scene descriptions under ``path``; every element is optional."""
    return spark.read.format("xml").options(**_options(root)).schema(_SCHEMA).load(path).select(*_scene_columns())


def stream_scene_xml(spark: SparkSession, path: str, root: str = SCENE_XML_ROOT, files_per_trigger: int = 1000) -> DataFrame:
    """The same rows from newly arriving files."""
    return spark.readStream.format("xml").options(**_options(root)).option(
        "maxFilesPerTrigger", files_per_trigger).schema(_SCHEMA).load(path).select(*_scene_columns())


def parse_scene_xml(df: DataFrame, column: str = "xml", keep=()) -> DataFrame:
    """Scene descriptions held as text in a column."""
    parsed = df.select(*keep, F.from_xml(column, _SCHEMA, _options(SCENE_XML_ROOT)).alias("_x"))
    return parsed.select(*keep, "_x.*").select(*keep, *_scene_columns())


def _attributes(**parts) -> Column:
    """Element of attributes only; NULL (so omitted) when all are NULL."""
    fields = [as_text(c).alias(f"_{n}") for n, c in parts.items()]
    any_set = F.coalesce(*[as_text(c) for c in parts.values()])
    return F.when(any_set.isNotNull(), F.struct(*fields))


def as_text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def scene_xml_struct() -> Column:
    """Fields per family: S1 radar fields, S2 cloud and baseline, S3 frame/cycle, S5 absolute orbit."""
    family = F.substring("satellite", 1, 2)

    def only(families, c):
        return F.when(family.isin(*families), c)

    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    instrument = F.when(family == "S1", "C-SAR").when(family == "S2", "MSI").otherwise(F.col("instrument"))
    tiles = F.when(F.col("mgrs_tiles").isNotNull() & (family == "S2"), F.struct(
        F.lit(SCENE_XML_TILE_SOURCE).alias("_source"), F.array_join("mgrs_tiles", "\n").alias("_text")))
    return F.struct(
        F.col("scene_id").alias("IDENTIFIER"), _attributes(name="satellite").alias("SATELLITE"),
        instrument.alias("INSTRUMENT"),
        F.when(family == "S2", F.concat(F.lit("S2MSIL"), F.right("processing_level", F.lit(2)))).otherwise(
            F.col("product_type")).alias("PRODUCT_TYPE"),
        processing_level("satellite", "product_type", "processing_level").alias("PROCESSING_LEVEL"),
        _attributes(longitude="centroid_lon", latitude="centroid_lat").alias("CENTROID"),
        _attributes(percentage=only(["S2"], F.bround("cloud_pct", 0).cast("int"))).alias("ESA_CLOUD_COVER"),
        F.col("footprint_wkt").alias("ESA_TILEOUTLINE_FOOTPRINT_WKT"),
        _attributes(start_datetime_utc=F.date_format("start_time", stamp),
                    stop_datetime_utc=F.date_format("stop_time", stamp)).alias("ACQUISITION_TIME"),
        _attributes(software_version=only(["S2", "S5"], F.col("software_version")),
                    processingtime_utc=only(["S2", "S3", "S5"], F.col("processing_time")),
                    baselinecollection=only(["S3"], F.col("baseline_collection"))).alias("ESA_PROCESSING"),
        _attributes(values=only(["S1"], F.array_join("polarisations", ","))).alias("POLARISATION"),
        _attributes(values=only(["S1"], F.array_join("swaths", ","))).alias("SWATH"),
        _attributes(value=only(["S1"], F.col("mode"))).alias("MODE"),
        _attributes(relative=only(["S1", "S2", "S3"], F.col("relative_orbit")),
                    absolute=only(["S1", "S3", "S5"], F.col("absolute_orbit")),
                    frame=only(["S3"], F.col("frame")), cycle=only(["S3"], F.col("cycle"))).alias("ORBIT_NUMBERS"),
        _attributes(direction=only(["S1"], F.col("pass_direction"))).alias("PASS"),
        _attributes(size_bytes="size_bytes", md5_local="md5_local", md5_esa=F.upper("md5_esa")).alias("ZIPFILE"),
        tiles.alias("MGRSTILES"))


def scene_xml_text(scenes: DataFrame, root: str = SCENE_XML_ROOT, keep=("scene_id",)) -> DataFrame:
    """Description text per scene."""
    return scenes.select(*keep, F.to_xml(scene_xml_struct(), {"rowTag": root, "valueTag": "_text"}).alias("xml"))


def write_scene_xml(scenes: DataFrame, path: str, root: str = SCENE_XML_ROOT) -> None:
    """Text files of scene descriptions, readable by ``read_scene_xml``."""
    scene_xml_text(scenes, root).select(F.col("xml").alias("value")).write.mode("overwrite").text(path)
