"""Readers and writers on small files."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from swathframe.operators import normalise
from swathframe.operators.image_quality import log_metrics
from swathframe.operators.layout import tiles_to_pixels
from swathframe.plans.dataset_build import normalised_splits
from swathframe.sources import catalogue, geojson, scene_xml, stats_csv, tiles
from swathframe.streaming.scene_feed import append_catalogue


def test_npy_tiles(spark, tmp_path):
    for i in range(4):
        np.save(tmp_path / f"t{i}.npy", np.full((3, 2, 2), i, dtype=float) + np.arange(2))
    df = tiles.read_npy_tiles(spark, str(tmp_path), limit=3, bands=["a", "b"])
    assert sorted({r.tile_id for r in df.collect()}) == ["t0", "t1", "t2"]
    px = tiles_to_pixels(df.filter("tile_id = 't2' and band = 'b'"))
    assert px.count() == 6 and {r.value for r in px.collect()} == {3.0}
    np.save(tmp_path / "t9.npy", np.zeros((5, 5)))
    with pytest.raises(PySparkException):
        tiles.read_npy_tiles(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        tiles.read_npy_tiles(spark, str(tmp_path), limit=0)


def test_write_layout_and_materialize_once(spark, tmp_path):
    df = tiles.layout_columns(spark.range(3).withColumnRenamed("id", "tile_id"), "dataX", 1, 0, "train")
    tiles.write_tiles(df, str(tmp_path / "d"), ("split", "role", "sensor", "t"))
    assert (tmp_path / "d/split=train/role=dataX/sensor=1/t=0").is_dir()
    first = tiles.materialize_once(spark.range(3), str(tmp_path / "c"))
    again = tiles.materialize_once(spark.range(99), str(tmp_path / "c"))
    assert first.count() == again.count() == 3
    (tmp_path / "c/_SUCCESS").unlink()  # what a lost job leaves behind is not reused
    assert tiles.materialize_once(spark.range(5), str(tmp_path / "c")).count() == 5


def test_stats_csv_keeps_every_row(spark, tmp_path):
    df = spark.range(7).select(F.format_string("%d.tif", "id").alias("tile_id"), F.col("id").cast("double").alias("B2_min"), F.lit(9.0).alias("B2_max"))
    stats_csv.write_stats_csv(df, str(tmp_path / "out"), parts=2)
    files = sorted((tmp_path / "out").glob("*.csv"))
    assert len(files) == 2
    (tmp_path / "in").mkdir()
    (tmp_path / "in/B2_minmax.csv").write_text("tile_id,B2_min,B2_max\n1.tif,1,2\n")
    (tmp_path / "in/x_ndvi.csv").write_text("name,ndvi_min,ndvi_max\n1.tif,-1,1\n")
    assert stats_csv.read_stats_csv(spark, str(tmp_path / "in"), "B2").first().B2_max == 2.0
    assert stats_csv.read_stats_csv(spark, str(tmp_path / "in"), "ndvi").first().tile_id == "1.tif"
    with pytest.raises(FileNotFoundError):
        stats_csv.read_stats_csv(spark, str(tmp_path / "in"), "B9")
    assert sum(len(f.read_text().splitlines()) - 1 for f in files) == 7


def _collection(n, location=True):
    ring = [[149.5, -35.0], [150.0, -35.0], [150.0, -34.5], [149.5, -35.0]]
    return {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"location": f"t_{i}.tif"} if location else {}, "geometry": {"type": "Polygon", "coordinates": [ring]}} for i in range(n)]}


def test_geojson(spark, tmp_path):
    (tmp_path / "zone.geojson").write_text(json.dumps(_collection(1)))
    (tmp_path / "grid.geojson").write_text(json.dumps(_collection(2)))
    (tmp_path / "bad.geojson").write_text(json.dumps(_collection(1, location=False)))
    z = geojson.read_geojson_zone(spark, str(tmp_path / "zone.geojson")).first()
    assert (z.bbox.xmin, z.bbox.ymax, len(z.ring)) == (149.5, -34.5, 4)
    with pytest.raises(PySparkException):
        geojson.read_geojson_zone(spark, str(tmp_path / "grid.geojson")).collect()
    assert [r.location for r in geojson.read_tile_grid(spark, str(tmp_path / "grid.geojson")).collect()] == ["t_0.tif", "t_1.tif"]
    with pytest.raises(PySparkException):
        geojson.read_tile_grid(spark, str(tmp_path / "bad.geojson")).collect()
    wkt = geojson.zones_to_wkt(spark, str(tmp_path / "grid.geojson"))
    assert wkt.first().value == "POLYGON ((149.5 -35, 150 -35, 150 -34.5, 149.5 -35))"
    geojson.write_wkt(wkt, str(tmp_path / "wkt"))
    assert spark.read.text(str(tmp_path / "wkt")).count() == 2


def test_catalogue_pages_inventory_and_log(spark, tmp_path):
    feature = {"properties": {"title": "A", "quicklook": "http://x/a.png", "productIdentifier": "P", "cloudCover": 1.5,
                              "services": {"download": {"url": "u", "size": 3, "checksum": "sha1:zz"}}}}
    (tmp_path / "page.json").write_text(json.dumps({"features": [feature, feature]}))
    r = catalogue.read_catalogue(spark, str(tmp_path / "page.json")).first()
    assert (r.image_id, r.zip_url, r.md5, r.size) == ("A", "http://x/a.zip", None, 3)
    (tmp_path / "z").mkdir()
    (tmp_path / "z/a.zip").write_bytes(b"abc")
    inv = catalogue.file_inventory(spark, str(tmp_path / "z"), "*.zip").first()
    assert (inv.size_bytes, inv.md5) == (3, "900150983CD24FB0D6963F7D28E17F72")
    urls = spark.createDataFrame([("u1",), ("u2",)], "url string")
    catalogue.append_url_log(urls, str(tmp_path / "log"))
    catalogue.append_url_log(urls, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 4


def _xml(extra="", start="start_datetime_utc='2019-12-06 23:13:22.500000'"):
    from swathframe.constants import SCENE_XML_ROOT
    return (f"<?xml version='1.0'?>\n<{SCENE_XML_ROOT}>\n  <SATELLITE name='S2A' />\n  <ACQUISITION_TIME {start} />\n{extra}</{SCENE_XML_ROOT}>\n")


def test_scene_xml_optional_elements(spark, tmp_path):
    (tmp_path / "a.xml").write_text(_xml())
    (tmp_path / "b.xml").write_text(_xml(
        "  <CENTROID longitude='149.5' latitude='-35' />\n  <ESA_CLOUD_COVER percentage='7' />\n  <MODE value='IW' />\n"
        "  <MGRSTILES source='OTHER' >\n    99XXX\n  </MGRSTILES>\n  <MGRSTILES source='%s' >\n    55HFA\n    55HFB\n  </MGRSTILES>\n" % scene_xml.SCENE_XML_TILE_SOURCE +
        "  <ZIPFILE size_bytes='12' md5_local='AB' md5_esa='' />\n", "datetime_utc='2015-01-02 03:04:05'"))
    rows = {r.start_time.year: r for r in scene_xml.read_scene_xml(spark, str(tmp_path / "*.xml")).collect()}
    a, b = rows[2019], rows[2015]
    assert a.start_time == dt.datetime(2019, 12, 6, 23, 13, 22, 500000) and a.mgrs_tiles is None and a.cloud_pct is None
    assert b.mgrs_tiles == ["55HFA", "55HFB"] and b.cloud_pct == 7 and b.mode == "IW" and b.md5_esa is None and b.md5_local == "AB"


def test_scene_feed_appends_new_files_once(spark, tmp_path):
    src, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    src.mkdir()
    (src / "a.xml").write_text(_xml())
    for extra in (None, "b.xml"):
        if extra:
            (src / extra).write_text(_xml(start="start_datetime_utc='2020-01-06 00:00:00.000000'"))
        append_catalogue(scene_xml.stream_scene_xml(spark, str(src)), str(out), str(mark)).awaitTermination(120)
    assert sorted(r.ym for r in spark.read.parquet(str(out)).collect()) == ["2019-12", "2020-01"]


def test_scalers_round_trip_and_metric_log(spark, tmp_path):
    df = spark.createDataFrame([(1.0,), (3.0,)], "a double")
    normalise.save_scalers(normalise.fit_scaler(df, {"A": ["a"]}), str(tmp_path / "s"))
    s = normalise.load_scalers(spark, str(tmp_path / "s"))
    assert sorted(r.a for r in normalise.apply_scaler(df, s, {"A": ["a"]}).collect()) == [-1.0, 1.0]
    for step in (1, 2):
        log_metrics(spark.createDataFrame([("psnr", 30.0)], "name string, value double"), step, str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2


def test_normalised_splits_reuse_training_scalers(spark, tmp_path, sf_dir):
    from queries.fixtures import pixels
    px = pixels(spark, sf_dir).withColumn("split", F.when(F.col("tile_id") % 3 == 0, "val").when(F.col("tile_id") % 3 == 1, "test").otherwise("train"))
    out = normalised_splits(px, str(tmp_path / "n"))
    assert set(out) == {"train", "val", "test"}
    assert sum(d.count() for d in out.values()) == px.count()
    mean = out["train"].agg(F.avg("vv_t0") + F.avg("vv_t1")).first()[0]
    assert mean == pytest.approx(0, abs=1e-9)
    assert spark.read.parquet(str(tmp_path / "n/scalers")).count() == 4


def test_optical_product_is_parsed_once_and_read_as_by_xpath(spark):
    """Nulls, nested and split texts, prefixes and special values; no XPath column is left in the plan."""
    from pyspark.sql import functions as F
    from swathframe.sources import manifests
    texts = ["<r xmlns:n='u'><n:G><Product_Info><PROCESSING_LEVEL> L2 <b/>x</PROCESSING_LEVEL><D><SENSING_ORBIT_NUMBER>7</SENSING_ORBIT_NUMBER></D></Product_Info></n:G></r>",
             "<Product_Info><PROCESSING_LEVEL><b>no</b>tail &amp; more</PROCESSING_LEVEL></Product_Info>",
             "<r><Product_Info><PROCESSING_LEVEL/></Product_Info><Product_Info><PROCESSING_LEVEL>é</PROCESSING_LEVEL></Product_Info></r>",
             "<r><n:Product_Info xmlns:n='u'><PROCESSING_LEVEL>hidden</PROCESSING_LEVEL></n:Product_Info></r>", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "path long, xml string")
    out = manifests.sentinel2_manifest(df)
    by_xpath = df.select("path", F.trim(F.get(F.xpath("xml", F.lit("//Product_Info/PROCESSING_LEVEL/text()")), F.lit(0))))
    got = sorted(map(tuple, out.select("path", "processing_level").collect()))
    assert got == sorted(map(tuple, by_xpath.collect())) and got[1] == (1, "tail & more")
    special = "<r><Product_Image_Characteristics>%s</Product_Image_Characteristics></r>" % "".join(
        f"<Special_Values><SPECIAL_VALUE_TEXT>{n}</SPECIAL_VALUE_TEXT><SPECIAL_VALUE_INDEX>{v}</SPECIAL_VALUE_INDEX></Special_Values>"
        for n, v in (("OTHER", 3), (" NODATA\n", 5), ("SATURATED", 9)))
    row = manifests.sentinel2_manifest(spark.createDataFrame([(1, special)], "path long, xml string")).first()
    assert (row.nodata_value, row.saturated_value, row.processing_level) == (5, 9, None)
    assert "XPath" not in out._jdf.queryExecution().optimizedPlan().toString()
