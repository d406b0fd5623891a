"""From rasters to a split, normalised tile data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathframe.constants import TILE_SIZE
from swathframe.operators.grid import combine_bands, crop, mosaic, retile
from swathframe.operators.layout import attach
from swathframe.operators.normalise import normalise_dataset
from swathframe.operators.tile_checks import (
    conformed_tiles, split_train_val_test, tile_checks, unconformed_tiles,
)
from swathframe.sources.tiles import materialize_once


def build_tiles(images: DataFrame, bands, bbox, size: int = TILE_SIZE, overlap: int = 0, res: float = 1.0) -> DataFrame:
    """combine -> mosaic -> crop -> retile for one sensor and date.

    ``images``: source_order, x, y, band, value (map coordinates, y upwards).
    """
    merged = mosaic(combine_bands(images, bands, keys=("source_order", "x", "y")), bands)
    ulx, uly, lrx, lry = bbox
    inside = crop(merged, ulx, uly, lrx, lry)
    placed = inside.withColumn("row", F.floor((F.lit(float(uly)) - F.col("y")) / res).cast("int")).withColumn(
        "col", F.floor((F.col("x") - F.lit(float(ulx))) / res).cast("int"))
    extent = (int((uly - lry) / res) + 1, int((lrx - ulx) / res) + 1)
    return retile(placed, size, overlap, extent=extent).select("tile_id", "row", "col", *bands)


def conform_and_split(sets: dict, bands: dict, size: int = TILE_SIZE, train: float = 0.7, val: float = 0.2,
                      test: float = 0.1, seed=2, reference: str = "s1_t1", min_nonzero: float = 0.7) -> DataFrame:
    """Tiles fine in all four sets, with their split. ``sets``: s1_t0, s1_t1, s2_t0, s2_t1."""
    checked = [tile_checks(df, bands[name], size, min_nonzero) for name, df in sets.items()]
    good = conformed_tiles(sets[reference].select("tile_id").distinct(), unconformed_tiles(checked))
    return split_train_val_test(good, train, val, test, seed)


def with_split(pixels: DataFrame, split: DataFrame) -> DataFrame:
    return attach(pixels, split, ["tile_id"])


def normalised_splits(pixels: DataFrame, path: str, **options) -> dict:
    """Normalise ``train`` and reuse its scalers for ``val`` and ``test``; each split is written once."""
    out = {}
    train, scalers = normalise_dataset(pixels.filter(F.col("split") == "train"), stage=f"{path}/filled", **options)
    kept = materialize_once(scalers, f"{path}/scalers")
    out["train"] = materialize_once(train, f"{path}/train")
    for name in ("val", "test"):
        part, _ = normalise_dataset(pixels.filter(F.col("split") == name), scalers=kept, **options)
        out[name] = materialize_once(part, f"{path}/{name}")
    return out
