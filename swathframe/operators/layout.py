"""Pixel-table layout: key joins, channel stacking, tile arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathframe.constants import LABEL_BANDS, LABEL_CHANNELS, ROLE_LAYOUT, X_BANDS, X_CHANNELS

PIXEL_KEYS = ("tile_id", "row", "col")
SALTS = 16


def attach(df: DataFrame, dim: DataFrame, on, salt_by=("row", "col"), how: str = "inner",
           salts: int = SALTS) -> DataFrame:
    """Join per-group values to many rows per group without a hot partition.

    One group (a tile, a region) may hold a large share of the rows.  The row
    side is spread over ``salts`` sub-keys and the one-row-per-group side is
    repeated that many times, so no task gets a whole group.  Spark still
    broadcasts ``dim`` by itself when its size is below the broadcast limit.
    """
    on = list(on)
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), F.lit(salts)).cast("int"))
    right = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, on + ["_salt"], how).drop("_salt")


def select_channels(df: DataFrame, bands, suffix: str, keys=PIXEL_KEYS) -> DataFrame:
    """Keys plus the named bands renamed ``<band>_<suffix>``."""
    return df.select(*keys, *[F.col(b).alias(f"{b}_{suffix}") for b in bands])


def stack_channels(s1_t0: DataFrame, s1_t1: DataFrame, s2_t0: DataFrame, s2_t1: DataFrame,
                   keys=PIXEL_KEYS) -> DataFrame:
    """Radar of both dates and optical of t0 (the input), then optical of t1 (the label).

    Inner joins on the pixel key: the four inputs hash-partition once on the
    same key and every pixel is its own group, so a large tile spreads out.
    """
    radar, optical = ("vv", "vh"), ("r", "g", "b", "nir")
    parts = [select_channels(s1_t0, radar, "t0", keys), select_channels(s1_t1, radar, "t1", keys),
             select_channels(s2_t0, optical, "t0", keys), select_channels(s2_t1, optical, "t1", keys)]
    joined = reduce(lambda a, b: a.join(b, list(keys), "inner"), parts)
    return joined.select(*keys, *X_CHANNELS, *LABEL_CHANNELS)


def join_x_label(x: DataFrame, label: DataFrame, keys=PIXEL_KEYS) -> DataFrame:
    return x.join(label, list(keys), "inner")


def join_predictions(truth: DataFrame, predicted: DataFrame, bands, keys=PIXEL_KEYS,
                     truth_suffix: str = "true", predicted_suffix: str = "pred") -> DataFrame:
    """Truth and prediction of the same pixel, band by band."""
    return select_channels(truth, bands, truth_suffix, keys).join(
        select_channels(predicted, bands, predicted_suffix, keys), list(keys), "inner")


def channel_shape(layout: dict | None = None) -> dict:
    """Number of channels of each role, from the sensors and dates it stacks."""
    per_sensor = {1: 2, 2: 4}
    return {role: sum(per_sensor[sensor] for sensor, _ in parts)
            for role, parts in (layout or ROLE_LAYOUT).items()}


def band_count(tiles: DataFrame) -> DataFrame:
    """Bands present per tile, to check against ``channel_shape``."""
    return tiles.groupBy("tile_id").agg(F.countDistinct("band").alias("n_bands"))


def tiles_to_pixels(tiles: DataFrame) -> DataFrame:
    """(tile_id, band, n_rows, n_cols, values) -> one row per tile, band and position."""
    return tiles.select("tile_id", "band", "n_cols", F.posexplode("values").alias("pos", "value")).select(
        "tile_id", "band", F.floor(F.col("pos") / F.col("n_cols")).cast("int").alias("row"),
        (F.col("pos") % F.col("n_cols")).cast("int").alias("col"), F.col("value").cast("double").alias("value"))


def pixels_to_tiles(pixels: DataFrame, max_pixels: int = 1024 * 1024) -> DataFrame:
    """Row-major array per tile and band.

    An array is one tile, whose size is fixed when the grid is cut; a tile
    larger than ``max_pixels`` fails before anything is collected for it.
    """
    sizes = pixels.groupBy("tile_id", "band").agg(
        (F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    checked = sizes.withColumn("_ok", F.assert_true(
        F.col("n_rows").cast("long") * F.col("n_cols") <= max_pixels,
        F.format_string("tile %s is too large for one array: cut it first", F.col("tile_id").cast("string"))))
    # A NULL from assert_true keeps the check in the plan without adding a value.
    sized = attach(pixels, checked.filter(F.col("_ok").isNull()).drop("_ok"), ["tile_id", "band"])
    return sized.groupBy("tile_id", "band", "n_rows", "n_cols").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(
            (F.col("row") * F.col("n_cols") + F.col("col")).alias("pos"), "value"))),
            lambda s: s["value"]).alias("values"))


def melt(df: DataFrame, columns: dict, keys, name: str = "band", value: str = "value") -> DataFrame:
    """Long form: ``columns`` maps a label to the columns that carry it (one scan, no shuffle)."""
    pairs = [(label, c) for label, cs in columns.items() for c in cs]
    entries = F.array(*[F.struct(F.lit(label).alias(name), F.col(c).cast("double").alias(value))
                        for label, c in pairs])
    return df.select(*keys, F.explode(entries).alias("_e")).select(*keys, f"_e.{name}", f"_e.{value}")


def pooled_columns(x_bands: dict | None = None, label_bands: dict | None = None) -> dict:
    """Columns that share a band: every input channel plus the label channels of that band."""
    xb, lb = x_bands or X_BANDS, label_bands or LABEL_BANDS
    return {band: list(cols) + list(lb.get(band, [])) for band, cols in xb.items()}
