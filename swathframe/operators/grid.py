"""Raster algebra on pixel tables: bands, mosaics, crops, tiles, resampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathframe.constants import TILE_SIZE
from swathframe.functions.common import as_col, floor_div
from swathframe.operators.layout import attach


def combine_bands(images: DataFrame, bands, keys=("x", "y"), value: str = "value") -> DataFrame:
    """Single-band rows -> one column per band, in list order; each band exactly once per pixel."""
    aggs = []
    for b in bands:
        hit = F.col("band") == b
        n = F.count_if(hit)
        checked = F.when(n == 1, F.max(F.when(hit, F.col(value)))).otherwise(F.raise_error(
            F.format_string(f"band {b} found %d times", n)).cast("double"))
        aggs.append(checked.alias(b))
    return images.groupBy(*keys).agg(*aggs)


def mosaic(images: DataFrame, bands, order: str = "source_order", keys=("x", "y")) -> DataFrame:
    """Overlay on one grid: where images overlap, the later one in ``order`` wins.

    ``order`` is unique per position.  One maximum per band keeps the buffers
    primitive, so this is a hash aggregate.
    """
    return images.groupBy(*keys).agg(*[F.max_by(b, order).alias(b) for b in bands])


def mosaic_all(images: list[DataFrame], bands, keys=("x", "y")) -> DataFrame:
    ordered = [d.select(*keys, *bands, F.lit(i).alias("source_order")) for i, d in enumerate(images)]
    return mosaic(reduce(DataFrame.unionByName, ordered), bands, keys=keys)


def crop(df: DataFrame, ulx: float, uly: float, lrx: float, lry: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pixels inside the window, given upper-left then lower-right."""
    return df.filter((F.col(x) >= ulx) & (F.col(x) <= lrx) & (F.col(y) >= lry) & (F.col(y) <= uly))


def pad_bbox(bbox, offsets):
    """Four bounds plus four offsets (numbers, not Columns)."""
    if len(bbox) != 4 or len(offsets) != 4:
        raise ValueError("a bounding box and its offsets have four numbers each")
    return tuple(b + o for b, o in zip(bbox, offsets))


def retile(df: DataFrame, size: int = TILE_SIZE, overlap: int = 0, width: int = 2,
           keys=(), extent: tuple[int, int] | None = None) -> DataFrame:
    """Cut (row, col) images into tiles named ``<row>_<col>`` counted from 1.

    With an overlap a pixel belongs to several tiles.  The last tile of a
    row or column starts where the image is first fully covered, so edge tiles
    are smaller.  Without overlap no extent is needed and nothing is shuffled.
    """
    stride = size - overlap
    if stride <= 0:
        raise ValueError("overlap must be smaller than the tile")
    out = df
    if overlap:
        if extent is not None:
            out = out.withColumn("_rows", F.lit(extent[0])).withColumn("_cols", F.lit(extent[1]))
        elif keys:
            dims = df.groupBy(*keys).agg((F.max("row") + 1).alias("_rows"), (F.max("col") + 1).alias("_cols"))
            out = attach(out, dims, keys)
        else:
            dims = df.agg(F.struct((F.max("row") + 1).alias("r"), (F.max("col") + 1).alias("c")).alias("d"))
            out = out.withColumn("_d", dims.scalar()).withColumn("_rows", F.col("_d.r")).withColumn(
                "_cols", F.col("_d.c")).drop("_d")

    def tiles(pos: Column, n: str) -> Column:
        first = F.greatest(F.floor((pos - size) / stride) + 1, F.lit(0))
        last_tile = F.when(F.col(n) <= size, F.lit(0)).otherwise(F.ceil((F.col(n) - size) / stride))
        return F.sequence(first.cast("int"), F.least(F.floor(pos / stride), last_tile).cast("int"))

    if overlap:
        out = out.withColumn("_tr", F.explode(tiles(F.col("row"), "_rows")))
        out = out.withColumn("_tc", F.explode(tiles(F.col("col"), "_cols"))).drop("_rows", "_cols")
    else:
        out = out.withColumn("_tr", floor_div("row", size)).withColumn("_tc", floor_div("col", size))
    return (out.withColumn("tile_id", F.format_string(f"%0{width}d_%0{width}d", F.col("_tr") + 1, F.col("_tc") + 1))
            .withColumn("row", (F.col("row") - F.col("_tr") * stride).cast("int"))
            .withColumn("col", (F.col("col") - F.col("_tc") * stride).cast("int")).drop("_tr", "_tc"))


def band_select(df: DataFrame, bands, keys) -> DataFrame:
    return df.select(*keys, *bands)


def block_mean(df: DataFrame, bands, factor: int, keys=("tile_id",), flags=()) -> DataFrame:
    """Fine to coarse: mean of each factor x factor cell; flag bands take their first pixel."""
    aggs = [F.avg(b).alias(b) for b in bands]
    aggs += [F.min_by(F.col(f), F.struct("row", "col")).alias(f) for f in flags]
    return df.groupBy(*keys, floor_div("row", factor).alias("_r"), floor_div("col", factor).alias("_c")).agg(
        *aggs).withColumnsRenamed({"_r": "row", "_c": "col"})


def multilook(df: DataFrame, bands, range_looks: int = 2, azimuth_looks: int = 2, keys=("tile_id",)) -> DataFrame:
    """Mean intensity over looks."""
    return df.groupBy(*keys, floor_div("row", azimuth_looks).alias("_r"),
                      floor_div("col", range_looks).alias("_c")).agg(
        *[F.avg(b).alias(b) for b in bands]).withColumnsRenamed({"_r": "row", "_c": "col"})


def upsample_bilinear(df: DataFrame, bands, factor: int, keys=("tile_id",)) -> DataFrame:
    """Coarse to fine: each fine cell is the distance-weighted mean of the four nearest centres.

    A source cell sends its weighted value to the fine cells it touches and
    the sums meet in one aggregate; dividing by the weight total repeats the
    edge value outside the outermost centres.
    """
    k = factor

    def targets(axis: str) -> Column:
        s = F.col(axis)
        lo = F.ceil((s - 1 + 0.5) * k - 0.5).cast("int")
        hi = F.floor((s + 1 + 0.5) * k - 0.5).cast("int")
        reach = F.filter(F.sequence(F.greatest(lo, F.lit(0)), hi), lambda t: F.abs((t + 0.5) / k - 0.5 - s) < 1)
        return F.transform(reach, lambda t: F.struct(
            t.alias("t"), (1 - F.abs((t + 0.5) / k - 0.5 - s)).cast("double").alias("w"),
            (F.floor(t / k) == s).alias("home")))

    out = df.withColumn("_r", F.explode(targets("row"))).withColumn("_c", F.explode(targets("col")))
    w = F.col("_r.w") * F.col("_c.w")
    aggs = [F.try_divide(F.sum(F.col(b) * w), F.sum(F.when(F.col(b).isNotNull(), w))).alias(b) for b in bands]
    return out.groupBy(*keys, F.col("_r.t").alias("row"), F.col("_c.t").alias("col")).agg(
        *aggs, F.max(F.col("_r.home") & F.col("_c.home")).alias("_inside")).filter("_inside").drop("_inside")


def reproject(df: DataFrame, target: DataFrame, to_source, origin: tuple[float, float], res: float,
              bands, method: str = "nearest") -> DataFrame:
    """Sample a source grid at target cell centres.

    ``target`` has one row per output cell with its centre (x, y) in the output
    projection; ``to_source(x, y)`` gives a struct of source coordinates.  The
    source is (row, col) with its upper-left corner at ``origin``.  Cells that
    fall outside the source are dropped.
    """
    keys = target.columns
    at = target.withColumn("_p", to_source(F.col("x"), F.col("y")))
    fields = at.schema["_p"].dataType.names
    u = (F.col(f"_p.{fields[0]}") - F.lit(origin[0])) / F.lit(res)
    v = (F.lit(origin[1]) - F.col(f"_p.{fields[1]}")) / F.lit(res)
    source = df.select(F.col("row").alias("_sr"), F.col("col").alias("_sc"), *[F.col(b).alias(f"_s_{b}") for b in bands])
    if method == "nearest":
        hit = at.withColumn("_sr", F.floor(v).cast("int")).withColumn("_sc", F.floor(u).cast("int"))
        return hit.join(source, ["_sr", "_sc"]).select(*keys, *[F.col(f"_s_{b}").alias(b) for b in bands])
    if method != "bilinear":
        raise ValueError(f"unknown resampling method {method!r}")
    near = at.withColumn("_u", u - 0.5).withColumn("_v", v - 0.5)
    corners = F.array(*[F.struct((F.floor("_v") + i).cast("int").alias("_sr"), (F.floor("_u") + j).cast("int").alias("_sc"))
                        for i in (0, 1) for j in (0, 1)])
    near = near.withColumn("_n", F.explode(corners)).select(
        *keys, "_n._sr", "_n._sc",
        ((1 - F.abs(F.col("_v") - F.col("_n._sr"))) * (1 - F.abs(F.col("_u") - F.col("_n._sc")))).alias("_w"))
    joined = near.join(source, ["_sr", "_sc"])
    return joined.groupBy(*keys).agg(*[F.try_divide(F.sum(F.col(f"_s_{b}") * F.col("_w")), F.sum("_w")).alias(b)
                                       for b in bands])


def merge_view_angles(angles: DataFrame, value: str = "value") -> DataFrame:
    """Detector grids overlaid in order: the last detector with a value wins."""
    v = F.col(value)
    return angles.filter(v.isNotNull() & ~F.isnan(v)).groupBy("band", "row", "col").agg(
        F.max_by(v, F.col("detector")).alias(value))


def join_landclass(pixels: DataFrame, landclass: DataFrame, x0: float, y0: float, res: float) -> DataFrame:
    """Class of the land-cover cell each pixel centre falls in (both sides on one grid)."""
    located = pixels.withColumn("_lx", floor_div(F.col("x") - x0, res)).withColumn("_ly", floor_div(F.lit(y0) - F.col("y"), res))
    cells = landclass.select(floor_div(F.col("x") - x0, res).alias("_lx"), floor_div(F.lit(y0) - F.col("y"), res).alias("_ly"),
                             F.col("class_id"))
    return located.join(cells, ["_lx", "_ly"]).drop("_lx", "_ly")


def landclass_of_tiles(landclass: DataFrame, tiles: DataFrame, tile_width: float, tile_height: float) -> DataFrame:
    """Land-cover pixels inside tile footprints.

    The range condition ``x0 <= x < x1`` becomes an equi join: each tile lists
    the coarse cells (one tile wide) it overlaps, the exact test follows.
    """
    def cells(lo, hi, step):
        return F.sequence(floor_div(lo, step), floor_div(hi, step))

    spread = tiles.withColumn("_gx", F.explode(cells("x0", "x1", tile_width))).withColumn(
        "_gy", F.explode(cells("y0", "y1", tile_height)))
    points = landclass.withColumn("_gx", floor_div("x", tile_width)).withColumn("_gy", floor_div("y", tile_height))
    inside = ((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
              & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")))
    return points.join(spread, ["_gx", "_gy"]).filter(inside).select("tile_id", "x", "y", "class_id")


def georeference(predictions: DataFrame, tiles: DataFrame, res: float) -> DataFrame:
    """Map coordinates of predicted pixels from the footprint of the original tile."""
    placed = attach(predictions, tiles.select("tile_id", "x0", "y0"), ["tile_id"])
    return placed.withColumn("x", F.col("x0") + F.col("col") * F.lit(res)).withColumn(
        "y", F.col("y0") - F.col("row") * F.lit(res)).drop("x0", "y0")


def scale_to_max(df: DataFrame, value: str, keys=("tile_id",), name: str = "scaled") -> DataFrame:
    """Divide by the maximum of the tile."""
    top = df.groupBy(*keys).agg(F.max(value).alias("_max"))
    return attach(df, top, keys).withColumn(name, F.try_divide(as_col(value), F.col("_max"))).drop("_max")
