"""Tile quality control, splitting and sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathframe.constants import CLOUD_MASK_VALUES, CLOUD_PIXEL_LIMIT, MIN_NONZERO_SHARE, SPLITS, TILE_SIZE
from swathframe.functions.common import total
from swathframe.operators.layout import attach


def tile_checks(df: DataFrame, bands, size: int = TILE_SIZE, min_nonzero: float = MIN_NONZERO_SHARE,
                mask: str | None = None, cloud_limit: int = CLOUD_PIXEL_LIMIT, keep_clouds: bool = False,
                band_meta: DataFrame | None = None, skip_last_band: bool = False) -> DataFrame:
    """All rejection tests of a tile in one aggregate, plus the first failing ``reason`` (NULL if fine).

    ``band_meta`` (tile_id, band_no, nodata) declares no-data values; with
    ``skip_last_band`` the last band of a tile (the mask) is not looked at.
    """
    nonzero = total([F.when(F.col(b) != 0, 1).otherwise(0) for b in bands])
    aggs = [(F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"),
            F.sum(nonzero).cast("long").alias("n_nonzero"),
            (F.count(F.lit(1)) * len(bands)).alias("n_values")]
    aggs.append((F.count_if(F.col(mask).isin(*CLOUD_MASK_VALUES)) if mask else F.lit(0).cast("long")).alias("n_cloud"))
    out = df.groupBy("tile_id").agg(*aggs)
    out = out.withColumn("wrong_size", (F.col("n_rows") != size) | (F.col("n_cols") != size))
    out = out.withColumn("no_signal", F.col("n_nonzero") < F.col("n_values") * F.lit(min_nonzero))
    out = out.withColumn("cloudy", F.col("n_cloud") > cloud_limit)
    if band_meta is None:
        out = out.withColumn("no_data", F.lit(False))
    else:
        out = out.join(has_no_data(band_meta, skip_last_band), "tile_id", "left").withColumn(
            "no_data", F.coalesce("no_data", F.lit(False)))
    reason = (F.when(F.col("wrong_size"), F.lit("wrong_size")).when(F.col("no_signal"), F.lit("no_signal"))
              .when(F.col("cloudy") & F.lit(bool(mask) and not keep_clouds), F.lit("cloudy"))
              .when(F.col("no_data"), F.lit("no_data")))
    return out.withColumn("reason", reason).withColumn("conform", F.col("reason").isNull())


def has_no_data(band_meta: DataFrame, skip_last_band: bool = False) -> DataFrame:
    """Tiles of which some band declares a no-data value."""
    if not skip_last_band:
        return band_meta.groupBy("tile_id").agg(F.max(F.col("nodata").isNotNull()).alias("no_data"))
    per_tile = band_meta.groupBy("tile_id").agg(
        F.max(F.when(F.col("nodata").isNotNull(), F.lit(1)).otherwise(F.lit(0))).alias("_any"),
        F.count_if(F.col("nodata").isNotNull()).alias("_n"),
        F.max_by(F.col("nodata").isNotNull(), "band_no").alias("_last"))
    return per_tile.select("tile_id", ((F.col("_n") - F.col("_last").cast("int")) > 0).alias("no_data"))


def unconformed_tiles(checked: list[DataFrame]) -> DataFrame:
    """Distinct ids that fail in any of the checked sets."""
    bad = [c.filter(~F.col("conform")).select("tile_id") for c in checked]
    return reduce(DataFrame.unionByName, bad).distinct()


def conformed_tiles(tiles: DataFrame, bad: DataFrame) -> DataFrame:
    """Rows (tiles or their pixels) whose tile is not rejected; a large tile is spread over several tasks."""
    return attach(tiles, bad.select("tile_id").distinct(), ["tile_id"], salt_by=tiles.columns, how="left_anti")


def shuffle_key(column: str, seed) -> Column:
    """Reproducible pseudo-random order of ids, the same in any engine with md5."""
    return F.md5(F.concat(F.lit(str(seed)), F.col(column).cast("string")))


def ordered_position(ids: DataFrame, column: str, seed, name: str = "position") -> DataFrame:
    """1-based global rank by shuffle key without sorting everything in one task.

    The key is uniform, so its first three hex digits cut the ids into 4096
    even buckets; rank inside the bucket plus the number of ids in earlier
    buckets is the global rank.
    """
    keyed = ids.withColumn("_key", shuffle_key(column, seed)).withColumn("_bucket", F.substring("_key", 1, 3))
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most 4096 rows by construction: one small ordered window.
    before = sizes.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_key", column))
    return keyed.withColumn("_within", within).join(F.broadcast(before), "_bucket").withColumn(
        name, (F.col("_before") + F.col("_within")).cast("long")).drop("_key", "_bucket", "_within", "_before")


def split_train_val_test(tiles: DataFrame, train: float, val: float, test: float, seed=2, column: str = "tile_id") -> DataFrame:
    """Exact-size split: test is cut first, then validation from the rest."""
    if abs(train + val + test - 1) > 1e-9:
        raise ValueError("the split fractions must sum to 1")
    ids = tiles.select(column).distinct()
    n = ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_test = F.ceil(F.round(n * F.lit(test), 9))
    n_val = F.ceil(F.round((n - n_test) * F.lit(val / (val + train)), 9))
    ranked = ordered_position(ids, column, seed)
    return ranked.select(column, F.when(F.col("position") <= n_test, F.lit(SPLITS[2])).when(
        F.col("position") <= n_test + n_val, F.lit(SPLITS[1])).otherwise(F.lit(SPLITS[0])).alias("split"))


def sample_tiles(tiles: DataFrame, n: int, seed=2, column: str = "tile_id") -> DataFrame:
    """Seeded sample of ``n`` distinct ids without replacement (all of them if there are fewer)."""
    ids = tiles.select(column).distinct()
    return ids.orderBy(shuffle_key(column, seed), column).limit(n)


def first_tiles(tiles: DataFrame, n: int, order: str = "tile_id") -> DataFrame:
    return tiles.select(order).distinct().orderBy(order).limit(n)
