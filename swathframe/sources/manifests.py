"""Product metadata of four satellite families -> one scene schema.

Input rows are ``(path, xml)`` for the XML families and ``(path, meta MAP)``
for the fifth satellite.  The first and third family are read with XPath
columns, which parse the text once for each path; products of the second are
parsed once.
"""

from __future__ import annotations

from xml.etree.ElementTree import Element, TreeBuilder
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from swathframe.functions.common import as_col
from swathframe.functions.geometry import centroid, close_ring, point, utm_epsg, utm_zone
from swathframe.functions.names import file_name, product_name_fields

_TIME = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]['Z']"


def _named(part: str) -> str:
    """Any element whose qualified name contains the text."""
    return f"*[contains(name(),'{part}')]"


def _section(identifier: str) -> str:
    return f"//metadataObject[@ID='{identifier}']"


def _text(xml: Column, path: str) -> Column:
    """First matching text, NULL when there is none."""
    return F.trim(F.get(F.xpath(xml, F.lit(f"{path}/text()")), F.lit(0)))


def _texts(xml: Column, path: str) -> Column:
    return F.sort_array(F.transform(F.xpath(xml, F.lit(f"{path}/text()")), lambda t: F.trim(t)))


def _attr(xml: Column, path: str) -> Column:
    return F.get(F.xpath(xml, F.lit(path)), F.lit(0))


def _stamp(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit(_TIME))


def ring_from_flat(text) -> Column:
    """``lat lon lat lon ...`` -> ring with longitude first."""
    v = F.split(F.trim(as_col(text)), "\\s+")
    return F.transform(F.sequence(F.lit(0), (F.size(v) / 2).cast("int") - 1),
                       lambda i: point(F.get(v, 2 * i + 1).cast("double"), F.get(v, 2 * i).cast("double")))


def ring_from_pairs(text) -> Column:
    """``lat,lon lat,lon ...`` -> closed ring with longitude first."""
    pairs = F.transform(F.split(F.trim(as_col(text)), "\\s+"), lambda p: F.split(p, ","))
    return close_ring(F.transform(pairs, lambda p: point(p[1].cast("double"), p[0].cast("double"))))


def _with_centroid(df: DataFrame) -> DataFrame:
    """Centroid in the footprint's UTM zone; none for long strips, polar areas and several polygons."""
    out = df.withColumn("_epsg", utm_epsg("footprint"))
    usable = utm_zone("_epsg").isNotNull() & (F.col("n_polygons") == 1)
    return out.withColumn("_c", F.when(usable, centroid("footprint", "_epsg"))).withColumn(
        "centroid_lon", F.col("_c.lon")).withColumn("centroid_lat", F.col("_c.lat")).drop("_c", "_epsg")


def sentinel1_manifest(df: DataFrame, xml: str = "xml", path: str = "path") -> DataFrame:
    x = F.col(xml)
    info = f"{_section('generalProductInformation')}//{_named('standAloneProductInformation')}"
    platform = _section("platform")
    frames = F.xpath(x, F.lit(f"{_section('measurementFrameSet')}//{_named('coordinates')}/text()"))
    family = _text(x, f"{platform}//{_named('familyName')}")
    number = _text(x, f"{platform}//{_named('number')}")
    by_name = product_name_fields(file_name(path))
    orbit = f"{_section('measurementOrbitReference')}"
    out = df.select(
        F.col(path).alias("path"),
        F.coalesce(F.concat(F.left(family, F.lit(1)), F.right(family, F.lit(1)), number), by_name["sat_id"]).alias("sat_id"),
        F.lit("C-SAR").alias("instrument"),
        F.coalesce(_text(x, f"{info}//{_named('productType')}"), by_name["product_type"]).alias("product_type"),
        _texts(x, f"{info}//{_named('transmitterReceiverPolarisation')}").alias("polarisations"),
        F.coalesce(_stamp(_text(x, f"{_section('acquisitionPeriod')}//{_named('startTime')}")), by_name["start_time"]).alias("start_time"),
        F.coalesce(_stamp(_text(x, f"{_section('acquisitionPeriod')}//{_named('stopTime')}")), by_name["stop_time"]).alias("stop_time"),
        F.coalesce(_text(x, f"{platform}//{_named('instrumentMode')}//{_named('mode')}"), by_name["mode"]).alias("mode"),
        _texts(x, f"{platform}//{_named('instrumentMode')}//{_named('swath')}").alias("swaths"),
        F.coalesce(_text(x, f"{orbit}//{_named('orbitNumber')}").cast("int"), by_name["absolute_orbit"]).alias("absolute_orbit"),
        _text(x, f"{orbit}//{_named('relativeOrbitNumber')}").cast("int").alias("relative_orbit"),
        F.initcap(_text(x, f"{orbit}//*[name()='s1:pass']")).alias("pass_direction"),
        ring_from_pairs(F.get(frames, F.lit(0))).alias("footprint"), F.size(frames).alias("n_polygons"))
    return _with_centroid(out)


def parse_xml(text: str) -> Element:
    """The document below a root of its own; names go without their prefixes, as an XPath column compares them."""
    tree, parser = TreeBuilder(), expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler = lambda name, attributes: tree.start(name[name.find(":") + 1:], attributes)
    parser.EndElementHandler, parser.CharacterDataHandler = tree.end, tree.data
    tree.start("", {})
    parser.Parse(text.encode("utf-8"), True)
    tree.end("")
    return tree.close()


def _first_text(elements) -> str | None:
    """First piece of text that stands directly in one of the elements."""
    return next((t for e in elements for t in (e.text, *(c.tail for c in e)) if t), None)


def _special(root: Element, name: str) -> str | None:
    """Index of the special value of that name, blanks around and between its words normalised."""
    values = root.iterfind(".//Product_Image_Characteristics/Special_Values")
    named = (v for v in values if any(" ".join("".join(t.itertext()).split()) == name for t in v.findall("SPECIAL_VALUE_TEXT")[:1]))
    return _first_text(e for v in named for e in v.findall("SPECIAL_VALUE_INDEX"))


_INFO, _IMAGE = ".//Product_Info", ".//Product_Image_Characteristics"
_S2_PATHS = {
    "spacecraft": f"{_INFO}/Datatake/SPACECRAFT_NAME", "level": f"{_INFO}/PROCESSING_LEVEL", "baseline": f"{_INFO}/PROCESSING_BASELINE",
    "start": f"{_INFO}/PRODUCT_START_TIME", "stop": f"{_INFO}/PRODUCT_STOP_TIME", "generated": f"{_INFO}/GENERATION_TIME",
    "orbit": f"{_INFO}//SENSING_ORBIT_NUMBER", "cloud": ".//Cloud_Coverage_Assessment", "ring": ".//Global_Footprint/EXT_POS_LIST",
    "scale": f"{_IMAGE}/QUANTIFICATION_VALUE", "boa": f"{_IMAGE}/QUANTIFICATION_VALUES_LIST/BOA_QUANTIFICATION_VALUE",
    "aot": f"{_IMAGE}/QUANTIFICATION_VALUES_LIST/AOT_QUANTIFICATION_VALUE", "wvp": f"{_IMAGE}/QUANTIFICATION_VALUES_LIST/WVP_QUANTIFICATION_VALUE"}
_S2_SPECIAL = {"nodata": "NODATA", "saturated": "SATURATED"}


def _s2_texts(text: str | None) -> list[str | None] | None:
    if not text:
        return None
    root = parse_xml(text)
    return [*(_first_text(root.iterfind(p)) for p in _S2_PATHS.values()), *(_special(root, n) for n in _S2_SPECIAL.values())]


def sentinel2_manifest(df: DataFrame, xml: str = "xml", path: str = "path") -> DataFrame:
    def run(batches):
        for batch in batches:
            texts = pa.array([_s2_texts(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.record_batch([batch.column(0), texts], names=["path", "texts"])

    own = df.select(F.col(path).alias("path"), F.col(xml).alias("xml"))
    read = own.mapInArrow(run, StructType([own.schema["path"]]).add("texts", ArrayType(StringType())))
    x = {name: F.trim(F.get("texts", F.lit(i))) for i, name in enumerate([*_S2_PATHS, *_S2_SPECIAL])}
    out = read.select(
        "path",
        F.concat(F.lit("S"), F.get(F.split(x["spacecraft"], "-"), F.lit(1))).alias("sat_id"),
        F.lit("MSI").alias("instrument"),
        x["level"].alias("processing_level"), x["baseline"].alias("software_version"),
        _stamp(x["start"]).alias("start_time"), _stamp(x["stop"]).alias("stop_time"), _stamp(x["generated"]).alias("generation_time"),
        x["orbit"].cast("int").alias("relative_orbit"), x["cloud"].cast("double").alias("cloud_pct"),
        ring_from_flat(x["ring"]).alias("footprint"), F.lit(1).alias("n_polygons"),
        F.coalesce(x["scale"], x["boa"]).cast("double").alias("scale_value"),
        x["aot"].cast("double").alias("aot_scale_value"), x["wvp"].cast("double").alias("wvp_scale_value"),
        x["nodata"].cast("int").alias("nodata_value"), x["saturated"].cast("int").alias("saturated_value"))
    return _with_centroid(out)


def sentinel3_manifest(df: DataFrame, xml: str = "xml", path: str = "path") -> DataFrame:
    x = F.col(xml)
    platform, info, orbit = _section("platform"), _section("generalProductInformation"), _section("measurementOrbitReference")
    objects = "//dataObjectSection/dataObject"
    product = _text(x, f"{info}//*[name()='sentinel3:productType']")
    out = df.select(
        F.col(path).alias("path"),
        F.concat(F.lit("S3"), _text(x, f"{platform}//*[name()='sentinel-safe:number']")).alias("sat_id"),
        _attr(x, f"{platform}//*[name()='sentinel-safe:instrument']//*[name()='sentinel-safe:familyName']/@abbreviation").alias("instrument"),
        product.alias("product_type"), F.substring(product, 4, 1).alias("processing_level"),
        F.substring(product, 6, 1000).alias("product_name"),
        _stamp(_text(x, f"{_section('acquisitionPeriod')}//*[name()='sentinel-safe:startTime']")).alias("start_time"),
        _stamp(_text(x, f"{_section('acquisitionPeriod')}//*[name()='sentinel-safe:stopTime']")).alias("stop_time"),
        F.try_to_timestamp(_text(x, f"{info}//*[name()='sentinel3:creationTime']"), F.lit("yyyyMMdd'T'HHmmss")).alias("generation_time"),
        _text(x, f"{info}//*[name()='sentinel3:baselineCollection']").alias("baseline_collection"),
        _text(x, f"{info}//*[name()='sentinel3:alongtrackCoordinate']").cast("int").alias("frame"),
        _text(x, f"{orbit}//*[name()='sentinel-safe:relativeOrbitNumber']").cast("int").alias("relative_orbit"),
        _text(x, f"{orbit}//*[name()='sentinel-safe:orbitNumber']").cast("int").alias("absolute_orbit"),
        _text(x, f"{orbit}//*[name()='sentinel-safe:cycleNumber']").cast("int").alias("cycle"),
        ring_from_flat(_text(x, f"{_section('measurementFrameSet')}//*[name()='gml:posList']")).alias("footprint"),
        F.lit(1).alias("n_polygons"),
        F.map_from_arrays(F.xpath(x, F.lit(f"{objects}//fileLocation/@href")),
                          F.transform(F.xpath(x, F.lit(f"{objects}//checksum/text()")), lambda t: F.trim(t))).alias("md5"))
    return _with_centroid(out)


def sentinel5_manifest(df: DataFrame, meta: str = "meta", path: str = "path") -> DataFrame:
    m = F.col(meta)
    footprint = "METADATA_EOP_METADATA_om:featureOfInterest_eop:multiExtentOf_gml:surfaceMembers_gml:exterior_gml:posList"
    out = df.select(
        F.col(path).alias("path"), m["platform"].alias("sat_id"), m["sensor"].alias("instrument"),
        m["METADATA_GRANULE_DESCRIPTION_ProductShortName"].alias("product_type"),
        m["METADATA_GRANULE_DESCRIPTION_ProcessLevel"].alias("processing_level"),
        m["processor_version"].alias("software_version"), _stamp(m["time_coverage_start"]).alias("start_time"),
        _stamp(m["time_coverage_end"]).alias("stop_time"), _stamp(m["date_created"]).alias("generation_time"),
        m["orbit"].cast("int").alias("absolute_orbit"), ring_from_flat(m[footprint]).alias("footprint"),
        F.lit(1).alias("n_polygons"))
    return _with_centroid(out)


def normalise_manifests(s1: DataFrame | None = None, s2: DataFrame | None = None, s3: DataFrame | None = None,
                        s5: DataFrame | None = None) -> DataFrame:
    """All families in one schema; fields a family lacks are NULL."""
    parts = [f(d) for f, d in ((sentinel1_manifest, s1), (sentinel2_manifest, s2), (sentinel3_manifest, s3),
                               (sentinel5_manifest, s5)) if d is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
