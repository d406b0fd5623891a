"""Text formats: catalogue features, zone texts, scene descriptions, product manifests."""

from pyspark.sql import functions as F

from queries.fixtures import SQL_SCENES, rd, rounded, scenes
from queries.registry import query
from swathframe.sources import catalogue, manifests, scene_xml
from swathframe.sources.geojson import polygon_wkt


@query("zones_to_wkt", f"""WITH {SQL_SCENES}, n AS (SELECT scene_id, regexp_replace(CAST(xmin AS VARCHAR), '\\.0$', '') AS a, regexp_replace(CAST(ymin AS VARCHAR), '\\.0$', '') AS b,
    regexp_replace(CAST(xmax AS VARCHAR), '\\.0$', '') AS c, regexp_replace(CAST(ymax AS VARCHAR), '\\.0$', '') AS d FROM scenes)
  SELECT scene_id, concat('POLYGON ((', a, ' ', b, ', ', c, ' ', b, ', ', c, ' ', d, ', ', a, ' ', b, '))') AS wkt FROM n""")
def zones_to_wkt(spark, sf):
    p = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymin"))
    return scenes(spark, sf).select("scene_id", polygon_wkt(F.array(ring)).alias("wkt"))


@query("flatten_catalogue_features", f"""WITH {SQL_SCENES} SELECT concat('S', scene_id) AS image_id, concat('http://x/', scene_id, '.dl') AS download_url, concat('http://x/', scene_id, '.zip') AS zip_url,
    CASE WHEN scene_id % 3 <> 0 THEN md5(CAST(scene_id AS VARCHAR)) END AS md5, scene_id * 10 AS size, concat('P', scene_id) AS product_id, {rd('cloud_pct')} AS cloud_pct FROM scenes""")
def flatten_catalogue_features(spark, sf):
    """JSON features written from the scenes and read back; a third has another digest kind."""
    s = scenes(spark, sf)
    sid = F.col("scene_id").cast("string")
    kind = F.when(F.col("scene_id") % 3 != 0, "md5").otherwise("sha1")
    feature = F.struct(F.struct(
        F.concat(F.lit("S"), sid).alias("title"), F.concat(F.lit("http://x/"), sid, F.lit(".png")).alias("quicklook"),
        F.concat(F.lit("P"), sid).alias("productIdentifier"), F.col("cloud_pct").alias("cloudCover"),
        F.struct(F.struct(F.concat(F.lit("http://x/"), sid, F.lit(".dl")).alias("url"), (F.col("scene_id") * 10).alias("size"),
                          F.concat(kind, F.lit(":"), F.md5(sid)).alias("checksum")).alias("download")).alias("services")).alias("properties"))
    out = catalogue.flatten_catalogue_features(catalogue.parse_features(s.select(F.to_json(feature).alias("json"))))
    return out.withColumn("cloud_pct", rounded("cloud_pct"))


def described(spark, sf):
    """Scenes with every description field, some missing by family."""
    s, sid = scenes(spark, sf), F.col("scene_id")
    return s.select(
        F.concat(F.lit("P"), sid.cast("string")).alias("scene_id"), F.col("sat_id").alias("satellite"), F.lit("OLCI").alias("instrument"), "product_type",
        F.lit("Level-2A").alias("processing_level"), F.when(sid % 4 != 0, F.col("xmin")).alias("centroid_lon"), F.when(sid % 4 != 0, F.col("ymin")).alias("centroid_lat"),
        F.col("cloud_pct"), F.col("acquired_at").cast("timestamp").alias("start_time"), (F.col("acquired_at").cast("timestamp") + F.expr("INTERVAL 20 SECOND")).alias("stop_time"),
        F.concat(F.lit("POLYGON (("), sid.cast("string"), F.lit(" 1))")).alias("footprint_wkt"), F.lit("02.04").alias("software_version"),
        F.lit("2024-02-01").alias("processing_time"), F.lit("003").alias("baseline_collection"), "polarisations",
        F.array(F.lit("IW1"), F.lit("IW2")).alias("swaths"), "mode", (sid % 175).cast("int").alias("relative_orbit"), sid.cast("int").alias("absolute_orbit"),
        F.when(sid % 2 == 0, sid.cast("int")).alias("frame"), F.when(sid % 3 == 0, sid.cast("int")).alias("cycle"), "pass_direction",
        (sid * 1000).alias("size_bytes"), F.upper(F.md5(sid.cast("string"))).alias("md5_local"), F.when(sid % 5 == 0, F.md5(sid.cast("string"))).alias("md5_esa"),
        F.when(sid % 2 == 0, F.array(F.lit("55HFA"), F.lit("55HFB"))).alias("mgrs_tiles"))


@query("scene_xml_round_trip", f"""WITH {SQL_SCENES}, d AS (SELECT *, substr(sat_id, 1, 2) AS f FROM scenes)
  SELECT concat('P', scene_id) AS scene_id, sat_id AS satellite, CASE f WHEN 'S1' THEN 'C-SAR' WHEN 'S2' THEN 'MSI' ELSE 'OLCI' END AS instrument,
    CASE WHEN f = 'S2' THEN 'S2MSIL2A' ELSE product_type END AS product_type, {rd('CASE WHEN scene_id % 4 <> 0 THEN xmin END')} AS centroid_lon,
    CASE WHEN f = 'S2' THEN CAST(round_even(cloud_pct, 0) AS INT) END AS cloud_pct, strftime(acquired_at, '%Y-%m-%d %H:%M:%S.%f') AS start_time,
    strftime(acquired_at + INTERVAL 20 SECOND, '%Y-%m-%d %H:%M:%S.%f') AS stop_time, concat('POLYGON ((', scene_id, ' 1))') AS footprint_wkt,
    CASE WHEN f IN ('S2','S5') THEN '02.04' END AS software_version, CASE WHEN f = 'S3' THEN '003' END AS baseline_collection,
    CASE WHEN f = 'S1' THEN array_to_string(polarisations, '+') END AS polarisations, CASE WHEN f = 'S1' THEN 'IW1+IW2' END AS swaths, CASE WHEN f = 'S1' THEN mode END AS mode,
    CAST(CASE WHEN f IN ('S1','S2','S3') THEN scene_id % 175 END AS INT) AS relative_orbit, CAST(CASE WHEN f IN ('S1','S3','S5') THEN scene_id END AS INT) AS absolute_orbit,
    CAST(CASE WHEN f = 'S3' AND scene_id % 2 = 0 THEN scene_id END AS INT) AS frame, CASE WHEN f = 'S1' THEN pass_direction END AS pass_direction, scene_id * 1000 AS size_bytes,
    upper(md5(CAST(scene_id AS VARCHAR))) AS md5_local, CASE WHEN scene_id % 5 = 0 THEN upper(md5(CAST(scene_id AS VARCHAR))) END AS md5_esa,
    CASE WHEN f = 'S2' AND scene_id % 2 = 0 THEN '55HFA+55HFB' END AS mgrs_tiles FROM d""")
def scene_xml_round_trip(spark, sf):
    """Descriptions written as XML text and parsed back."""
    out = scene_xml.parse_scene_xml(scene_xml.scene_xml_text(described(spark, sf)))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    joined = lambda c: F.when(F.col(c).isNotNull(), F.array_join(c, "+")).alias(c)
    return out.select("scene_id", "satellite", "instrument", "product_type", rounded("centroid_lon").alias("centroid_lon"), "cloud_pct", stamp("start_time"), stamp("stop_time"),
                      "footprint_wkt", "software_version", "baseline_collection", joined("polarisations"), joined("swaths"), "mode", "relative_orbit", "absolute_orbit", "frame",
                      "pass_direction", "size_bytes", "md5_local", "md5_esa", joined("mgrs_tiles"))


def _s1_xml():
    sid = F.col("scene_id").cast("string")
    t = F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    n = lambda c: F.col(c).cast("string")
    pols = F.array_join(F.transform(F.reverse("polarisations"), lambda p: F.concat(
        F.lit("<s1sarl1:transmitterReceiverPolarisation>"), p, F.lit("</s1sarl1:transmitterReceiverPolarisation>"))), "")
    corners = F.concat_ws(" ", *[F.concat(n(y), F.lit(","), n(x)) for x, y in (("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"))])
    return F.concat(
        F.lit('<x:XFDU xmlns:x="u"><metadataSection><metadataObject ID="generalProductInformation"><s1sarl1:standAloneProductInformation>'),
        F.when(F.col("product_type") != "SLC", F.concat(F.lit("<s1sarl1:productType>"), "product_type", F.lit("</s1sarl1:productType>"))).otherwise(""), pols,
        F.lit('</s1sarl1:standAloneProductInformation></metadataObject><metadataObject ID="acquisitionPeriod"><safe:startTime>'), t,
        F.lit("</safe:startTime><safe:stopTime>"), t, F.lit('</safe:stopTime></metadataObject><metadataObject ID="platform"><safe:platform><safe:familyName>SENTINEL-1</safe:familyName><safe:number>'),
        F.substring("sat_id", 3, 1), F.lit("</safe:number><safe:instrument><s1:instrumentMode><s1:mode>"), "mode",
        F.lit('</s1:mode><s1:swath>IW2</s1:swath><s1:swath>IW1</s1:swath></s1:instrumentMode></safe:instrument></safe:platform></metadataObject><metadataObject ID="measurementOrbitReference"><safe:orbitReference><safe:orbitNumber>'),
        sid, F.lit("</safe:orbitNumber><safe:relativeOrbitNumber>"), (F.col("scene_id") % 175).cast("string"),
        F.lit("</safe:relativeOrbitNumber><s1:orbitProperties><s1:pass>"), "pass_direction",
        F.lit('</s1:pass></s1:orbitProperties></safe:orbitReference></metadataObject><metadataObject ID="measurementFrameSet"><gml:coordinates>'), corners,
        F.lit("</gml:coordinates></metadataObject></metadataSection></x:XFDU>"))


@query("normalise_manifests_s1", f"""WITH {SQL_SCENES} SELECT scene_id, sat_id, CASE WHEN product_type = 'SLC' THEN 'RAW' ELSE product_type END AS product_type, array_to_string(list_sort(polarisations), '+') AS polarisations,
    strftime(acquired_at, '%Y-%m-%d %H:%M:%S.%f') AS start_time, mode, 'IW1+IW2' AS swaths, CAST(scene_id AS INT) AS absolute_orbit, CAST(scene_id % 175 AS INT) AS relative_orbit,
    concat(substr(pass_direction, 1, 1), lower(substr(pass_direction, 2))) AS pass_direction, 5 AS n_vertices, {rd('xmin')} AS lon, {rd('ymin')} AS lat FROM scenes WHERE sat_id = 'S1A'""")
def normalise_manifests_s1(spark, sf):
    """Manifests of every radar scene; where the product type is missing the file name gives it."""
    s = scenes(spark, sf).filter("sat_id = 'S1A'")
    name = F.format_string("/in/%d/S1A_IW_RAW_0S.zip", "scene_id")
    out = manifests.normalise_manifests(s1=s.select(name.alias("path"), _s1_xml().alias("xml")))
    return out.select(F.get(F.split("path", "/"), F.lit(2)).cast("long").alias("scene_id"), "sat_id", "product_type", F.array_join("polarisations", "+").alias("polarisations"),
                      F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_time"), "mode", F.array_join("swaths", "+").alias("swaths"), "absolute_orbit", "relative_orbit",
                      "pass_direction", F.size("footprint").alias("n_vertices"), rounded(F.element_at("footprint", -1)["lon"]).alias("lon"), rounded(F.element_at("footprint", -1)["lat"]).alias("lat"))


@query("normalise_manifests_s5", f"""WITH {SQL_SCENES} SELECT scene_id, sat_id, 'L2__NO2' AS product_type, '2' AS processing_level, strftime(date_trunc('second', acquired_at), '%Y-%m-%d %H:%M:%S') AS start_time,
    CAST(scene_id AS INT) AS absolute_orbit, 4 AS n_vertices, {rd('xmax')} AS lon, {rd('ymin')} AS lat FROM scenes WHERE sat_id = 'S5P'""")
def normalise_manifests_s5(spark, sf):
    s = scenes(spark, sf).filter("sat_id = 'S5P'")
    n = lambda c: F.col(c).cast("string")
    t = F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    flat = F.concat_ws(" ", n("ymin"), n("xmin"), n("ymin"), n("xmax"), n("ymax"), n("xmax"), n("ymin"), n("xmin"))
    posted = "METADATA_EOP_METADATA_om:featureOfInterest_eop:multiExtentOf_gml:surfaceMembers_gml:exterior_gml:posList"
    entries = {"platform": F.lit("S5P"), "sensor": F.lit("TROPOMI"), "METADATA_GRANULE_DESCRIPTION_ProductShortName": F.lit("L2__NO2"),
               "METADATA_GRANULE_DESCRIPTION_ProcessLevel": F.lit("2"), "processor_version": F.lit("1.2"), "time_coverage_start": t, "time_coverage_end": t,
               "date_created": t, "orbit": F.col("scene_id").cast("string"), posted: flat}
    meta = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
    out = manifests.normalise_manifests(s5=s.select(F.col("scene_id").cast("string").alias("path"), meta.alias("meta")))
    return out.select(F.col("path").cast("long").alias("scene_id"), "sat_id", "product_type", "processing_level", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"),
                      "absolute_orbit", F.size("footprint").alias("n_vertices"), rounded(F.get("footprint", F.lit(1))["lon"]).alias("lon"), rounded(F.get("footprint", F.lit(1))["lat"]).alias("lat"))


def _tags(**parts):
    """<NAME>value</NAME> for each part; a Column value is data, text is fixed."""
    out = []
    for tag, v in parts.items():
        out += [F.lit(f"<{tag}>"), v if not isinstance(v, str) else F.lit(v), F.lit(f"</{tag}>")]
    return F.concat(*out)


def _flat_corners():
    n = lambda c: F.col(c).cast("string")
    return F.concat_ws(" ", n("ymin"), n("xmin"), n("ymin"), n("xmax"), n("ymax"), n("xmax"), n("ymin"), n("xmin"))


@query("normalise_manifests_s2", f"""WITH {SQL_SCENES} SELECT scene_id, sat_id, 'Level-2A' AS processing_level, strftime(acquired_at, '%Y-%m-%d %H:%M:%S.%f') AS start_time, CAST(scene_id % 143 AS INT) AS relative_orbit,
    {rd('scene_id % 100 + 0.5e0')} AS cloud_pct, 1e4 AS scale_value, CASE WHEN scene_id % 2 = 0 THEN 1000e0 END AS aot_scale_value, 0 AS nodata_value, 65535 AS saturated_value, 4 AS n_vertices FROM scenes WHERE sensor = 2""")
def normalise_manifests_s2(spark, sf):
    """Every second product has the list of quantification values instead of the single one."""
    s = scenes(spark, sf).filter("sensor = 2")
    t = F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    scale = F.when(F.col("scene_id") % 2 == 0, _tags(QUANTIFICATION_VALUES_LIST=_tags(
        BOA_QUANTIFICATION_VALUE="10000", AOT_QUANTIFICATION_VALUE="1000.0", WVP_QUANTIFICATION_VALUE="1000.0"))).otherwise(_tags(QUANTIFICATION_VALUE="10000"))
    special = F.concat(*[_tags(Special_Values=_tags(SPECIAL_VALUE_TEXT=n, SPECIAL_VALUE_INDEX=v)) for n, v in (("NODATA", "0"), ("SATURATED", "65535"))])
    sat = F.concat(F.lit("Sentinel-"), F.substring("sat_id", 2, 2))
    info = _tags(Product_Info=F.concat(_tags(PRODUCT_START_TIME=t, PRODUCT_STOP_TIME=t, PROCESSING_LEVEL="Level-2A", PROCESSING_BASELINE="02.04", GENERATION_TIME=t),
                                       _tags(Datatake=_tags(SPACECRAFT_NAME=sat, SENSING_ORBIT_NUMBER=(F.col("scene_id") % 143).cast("string")))),
                 Product_Image_Characteristics=F.concat(special, scale))
    xml = F.concat(F.lit('<n1:Root xmlns:n1="u"><n1:General_Info>'), info, F.lit("</n1:General_Info><n1:Geometric_Info><Product_Footprint><Product_Footprint><Global_Footprint><EXT_POS_LIST>"),
                   _flat_corners(), F.lit("</EXT_POS_LIST></Global_Footprint></Product_Footprint></Product_Footprint></n1:Geometric_Info><n1:Quality_Indicators_Info>"),
                   _tags(Cloud_Coverage_Assessment=(F.col("scene_id") % 100 + 0.5).cast("string")), F.lit("</n1:Quality_Indicators_Info></n1:Root>"))
    out = manifests.normalise_manifests(s2=s.select(F.col("scene_id").cast("string").alias("path"), xml.alias("xml")))
    return out.select(F.col("path").cast("long").alias("scene_id"), "sat_id", "processing_level", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_time"),
                      "relative_orbit", rounded("cloud_pct").alias("cloud_pct"), "scale_value", "aot_scale_value", "nodata_value", "saturated_value", F.size("footprint").alias("n_vertices"))


@query("normalise_manifests_s3", f"""WITH {SQL_SCENES} SELECT scene_id, sat_id, 'OL_1_EFR___' AS product_type, '1' AS processing_level, 'EFR___' AS product_name, strftime(acquired_at, '%Y-%m-%d %H:%M:%S.%f') AS start_time,
    CASE WHEN scene_id % 2 = 0 THEN 2340 END AS frame, CAST(scene_id AS INT) AS absolute_orbit, CAST(scene_id % 385 AS INT) AS relative_orbit, 46 AS cycle, 'OLCI' AS instrument,
    md5(CAST(scene_id AS VARCHAR)) AS first_md5, 2 AS n_files FROM scenes WHERE sat_id = 'S3A'""")
def normalise_manifests_s3(spark, sf):
    s = scenes(spark, sf).filter("sat_id = 'S3A'")
    sid = F.col("scene_id").cast("string")
    t = F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")

    def section(name, body):
        return F.concat(F.lit(f'<metadataObject ID="{name}">'), body, F.lit("</metadataObject>"))

    def tag(name, body):
        return F.concat(F.lit(f"<{name}>"), body if not isinstance(body, str) else F.lit(body), F.lit(f"</{name.split(' ')[0]}>"))

    files = F.concat(*[F.concat(F.lit(f'<dataObject><byteStream><fileLocation href="./{f}.nc"/>'), tag("checksum", F.md5(sid) if f == "a" else "0"), F.lit("</byteStream></dataObject>")) for f in "ab"])
    meta = F.concat(
        section("acquisitionPeriod", F.concat(tag("sentinel-safe:startTime", t), tag("sentinel-safe:stopTime", t))),
        section("platform", F.concat(tag("sentinel-safe:familyName", "Sentinel-3"), tag("sentinel-safe:number", "A"),
                                     tag("sentinel-safe:instrument", tag('sentinel-safe:familyName abbreviation="OLCI"', "Ocean Land Colour Instrument")))),
        section("measurementFrameSet", tag("gml:posList", _flat_corners())),
        section("generalProductInformation", F.concat(
            F.when(F.col("scene_id") % 2 == 0, tag("sentinel3:alongtrackCoordinate", "2340")).otherwise(""), tag("sentinel3:productType", "OL_1_EFR___"),
            tag("sentinel3:creationTime", "20240201T101010"), tag("sentinel3:baselineCollection", "003"))),
        section("measurementOrbitReference", F.concat(tag("sentinel-safe:orbitNumber", sid), tag("sentinel-safe:relativeOrbitNumber", (F.col("scene_id") % 385).cast("string")),
                                                      tag("sentinel-safe:cycleNumber", "46"))))
    xml = F.concat(F.lit("<xfdu:XFDU><metadataSection>"), meta, F.lit("</metadataSection><dataObjectSection>"), files, F.lit("</dataObjectSection></xfdu:XFDU>"))
    out = manifests.normalise_manifests(s3=s.select(sid.alias("path"), xml.alias("xml")))
    return out.select(F.col("path").cast("long").alias("scene_id"), "sat_id", "product_type", "processing_level", "product_name",
                      F.date_format("start_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start_time"), "frame", "absolute_orbit", "relative_orbit", "cycle", "instrument",
                      F.element_at("md5", "./a.nc").alias("first_md5"), F.size("md5").alias("n_files"))
