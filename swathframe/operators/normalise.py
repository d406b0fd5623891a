"""Normalisation: per-tile rescaling, group scalers, the whole input/label normaliser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathframe.constants import (
    OPTICAL_FACTOR, OPTICAL_GROUPS, OPTICAL_RANGE, SAR_FACTOR, SAR_GROUPS,
)
from swathframe.functions.common import clip
from swathframe.functions.rescale import rescale, statistic_for, to_db
from swathframe.operators.knn_fill import knn_fill
from swathframe.operators.layout import attach
from swathframe.operators.statistics import band_stats_wide, column_aggregates, pooled


def rescale_bands(df: DataFrame, columns: dict, methods: dict, keys=("tile_id",)) -> DataFrame:
    """Rescale each band's columns by its own per-tile statistics and its own method."""
    out, done = df, df.columns
    for kind in ("mean_std", "min_max"):
        group = {b: cs for b, cs in columns.items() if statistic_for(methods[b]) == kind}
        if group:
            out = attach(out, band_stats_wide(df, group, kind, keys), keys)
    return _apply(out, columns, methods, done)


def _apply(out: DataFrame, columns: dict, methods: dict, done) -> DataFrame:
    band_of = {c: b for b, cs in columns.items() for c in cs}
    return out.select(*[
        rescale(methods[band_of[c]], F.col(c), F.col(f"`{band_of[c]}_s1`"), F.col(f"`{band_of[c]}_s2`")).alias(c)
        if c in band_of else F.col(c) for c in done])


def normalise_image(df: DataFrame, columns: dict, method: str, keys=("tile_id",)) -> DataFrame:
    return rescale_bands(df, columns, {b: method for b in columns}, keys)


def join_tile_stats(df: DataFrame, stats: DataFrame, bands, divide_by: float = 10000.0, keys=("tile_id",)) -> DataFrame:
    """Per-tile ``<band>_min/_max`` next to each pixel; fails unless a tile has exactly one stats row.

    The count is taken where the table is small, so the pixels are joined once.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for b in bands:
        aggs += [F.max(f"{b}_min").alias(f"{b}_min"), F.max(f"{b}_max").alias(f"{b}_max")]
    one = stats.groupBy(*keys).agg(*aggs)
    joined = attach(df, one, keys, how="left")
    n = F.coalesce("_n", F.lit(0))
    ok = F.when(n == 1, F.lit(1.0)).otherwise(F.raise_error(
        F.format_string("expected one statistics row for tile %s, found %d", F.col(keys[0]).cast("string"), n)).cast("double"))
    scaled = [(F.col(f"{b}_{side}") / F.lit(float(divide_by)) * ok).alias(f"{b}_{side}")
              for b in bands for side in ("min", "max")]
    return joined.select(*df.columns, *scaled)


def override_stats(computed: DataFrame, given: DataFrame, keys=("tile_id",)) -> DataFrame:
    """Replace computed (s1, s2) by given ones per key and band; a given band must exist."""
    on = [*keys, "band"]
    new = given.select(*on, F.col("s1").alias("_g1"), F.col("s2").alias("_g2"))
    joined = computed.join(new, on, "full")
    known = F.when(F.col("s1").isNotNull() | F.col("_g1").isNull(), F.coalesce("_g1", "s1")).otherwise(
        F.raise_error(F.concat(F.lit("no computed statistic for band "), F.col("band"))).cast("double"))
    return joined.select(*on, known.alias("s1"), F.coalesce("_g2", "s2").alias("s2"))


def fit_scaler(df: DataFrame, groups: dict, factor: float = 1.0) -> DataFrame:
    """One mean and population deviation per band group over all pixels and all its columns.

    Zero deviation becomes 1.  One aggregate over one scan for all groups.
    """
    flat = sorted({c for cs in groups.values() for c in cs})
    partial = df.agg(*column_aggregates(flat, "mean_std"))
    entries = []
    for g, cs in groups.items():
        n, mean, std = pooled(list(cs), "mean_std")
        entries.append(F.struct(F.lit(g).alias("band_group"), mean.alias("mean"),
                                F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std"),
                                F.lit(float(factor)).alias("factor"), n.alias("n")))
    return partial.select(F.inline(F.array(*entries)))


def apply_scaler(df: DataFrame, scalers: DataFrame, groups: dict, invert: bool = False,
                 bounds: tuple[float, float] | None = None) -> DataFrame:
    """Forward ``(x-m)/s*f`` or inverse ``x/f*s+m`` for every column of every group.

    The few scaler rows reach the tasks as one scalar subquery: no join at all.
    A group that is not there exactly once fails.
    """
    names = list(groups)
    cells = []
    for i, g in enumerate(names):
        hit = F.col("band_group") == g
        once = F.when(F.count_if(hit) == 1, F.max(F.when(hit, F.struct("mean", "std", "factor")))).otherwise(
            F.raise_error(F.lit(f"scaler for {g} must be there exactly once")).cast(
                "struct<mean:double,std:double,factor:double>"))
        cells.append(once.alias(f"g{i}"))
    with_scaler = df.withColumn("_sc", scalers.agg(F.struct(*cells).alias("s")).scalar())
    group_of = {c: i for i, g in enumerate(names) for c in groups[g]}
    out = []
    for c in df.columns:
        if c not in group_of:
            out.append(F.col(c))
            continue
        m, s, f = (F.col(f"_sc.g{group_of[c]}.{p}") for p in ("mean", "std", "factor"))
        x = F.col(c) / f * s + m if invert else (F.col(c) - m) / s * f
        out.append((clip(x, F.lit(bounds[0]), F.lit(bounds[1])) if bounds else x).alias(c))
    return with_scaler.select(*out)


def save_scalers(scalers: DataFrame, path: str) -> None:
    scalers.coalesce(1).write.mode("overwrite").parquet(path)


def load_scalers(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def prepare_sar(df: DataFrame, columns, k: int = 5, log: bool = True) -> DataFrame:
    """Negatives become missing, are filled from the nearest image rows, then go to decibels."""
    if not log:
        return df
    cols = list(columns)
    masked = df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in cols})
    filled = knn_fill(masked, cols, k)
    return filled.withColumns({c: to_db(F.col(c)) for c in cols})


def normalise_dataset(df: DataFrame, sar_groups: dict | None = None, optical_groups: dict | None = None,
                      sar_factor: float = SAR_FACTOR, optical_factor: float = OPTICAL_FACTOR,
                      clip_optical: bool = True, log: bool = True, k: int = 5,
                      scalers: DataFrame | None = None, stage: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Normalise input and label together; returns (pixels, scalers).

    Optical groups pool the input (t0) and label (t1) columns in one scaler.
    Pass the training scalers to normalise validation or test data.  ``stage``
    is a folder of the caller's for the gap-filled table, which both the fit and
    the transform read; without it the gaps are filled in both plans.
    """
    sar = sar_groups or SAR_GROUPS
    optical = optical_groups or OPTICAL_GROUPS
    ready = prepare_sar(df, [c for cs in sar.values() for c in cs], k, log)
    if scalers is None:
        if stage is not None:
            ready.write.mode("overwrite").parquet(stage)
            ready = df.sparkSession.read.schema(ready.schema).parquet(stage)
        scalers = fit_scaler(ready, sar, sar_factor).unionByName(fit_scaler(ready, optical, optical_factor))
    out = apply_scaler(ready, scalers, sar)
    out = apply_scaler(out, scalers, optical, bounds=OPTICAL_RANGE if clip_optical else None)
    return out, scalers
