"""Band statistics, frequencies and histograms.

Statistics over several columns are aggregated column by column and combined
with the exact pooling formula afterwards, so pixels are never multiplied into
long form and the shuffle carries one partial row per tile and map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathframe.functions.common import clip, total
from swathframe.functions.indices import vegetation_index
from swathframe.functions.rescale import rescale
from swathframe.operators.layout import attach


def column_aggregates(columns, kind: str) -> list[Column]:
    """Partial statistics of each column, named ``<column>__n/__a/__b``."""
    out = []
    for c in columns:
        v = F.col(c).cast("double")
        a, b = (F.avg(v), F.stddev_pop(v)) if kind == "mean_std" else (F.min(v), F.max(v))
        out += [F.count(v).alias(f"{c}__n"), a.alias(f"{c}__a"), b.alias(f"{c}__b")]
    return out


def pooled(columns, kind: str) -> tuple[Column, Column, Column]:
    """(n, s1, s2) of several columns together from their partial statistics."""
    n = total([F.col(f"{c}__n") for c in columns])
    if kind == "min_max":
        mins, maxs = [F.col(f"{c}__a") for c in columns], [F.col(f"{c}__b") for c in columns]
        return n, (F.least(*mins) if len(mins) > 1 else mins[0]), (F.greatest(*maxs) if len(maxs) > 1 else maxs[0])

    def seen(c, v):
        return F.when(F.col(f"{c}__n") > 0, v).otherwise(F.lit(0.0))

    mean = F.try_divide(total([seen(c, F.col(f"{c}__n") * F.col(f"{c}__a")) for c in columns]), n)
    if len(columns) == 1:
        return n, F.col(f"{columns[0]}__a"), F.col(f"{columns[0]}__b")
    spread = total([seen(c, F.col(f"{c}__n") * (F.col(f"{c}__b") * F.col(f"{c}__b")
                    + (F.col(f"{c}__a") - mean) * (F.col(f"{c}__a") - mean))) for c in columns])
    return n, mean, F.sqrt(F.try_divide(spread, n))


def band_stats_wide(df: DataFrame, columns: dict, kind: str, keys=("tile_id",)) -> DataFrame:
    """One row per key with ``<band>_s1`` and ``<band>_s2``."""
    flat = sorted({c for cs in columns.values() for c in cs})
    partial = df.groupBy(*keys).agg(*column_aggregates(flat, kind))
    out = []
    for band, cs in columns.items():
        _, s1, s2 = pooled(list(cs), kind)
        out += [s1.alias(f"{band}_s1"), s2.alias(f"{band}_s2")]
    return partial.select(*keys, *out)


def band_stats(df: DataFrame, columns: dict, kind: str = "mean_std", keys=("tile_id",)) -> DataFrame:
    """(keys, band, s1, s2): mean and population deviation, or minimum and maximum."""
    if kind not in ("mean_std", "min_max"):
        raise ValueError(f"unknown statistic {kind!r}")
    flat = sorted({c for cs in columns.values() for c in cs})
    partial = df.groupBy(*keys).agg(*column_aggregates(flat, kind))
    entries = []
    for band, cs in columns.items():
        n, s1, s2 = pooled(list(cs), kind)
        entries.append(F.struct(F.lit(band).alias("band"), s1.alias("s1"), s2.alias("s2"), n.alias("n")))
    return partial.select(*keys, F.inline(F.array(*entries)))


def batch_stats(per_tile: DataFrame) -> DataFrame:
    """Mean of the per-tile statistics (not the pooled statistic)."""
    return per_tile.groupBy("band").agg(F.avg("s1").alias("s1"), F.avg("s2").alias("s2"))


def tile_band_minmax(df: DataFrame, bands, keys=("tile_id",), begin=None, end=None, time: str = "acquired_at") -> DataFrame:
    """Per tile, over all acquisitions in [begin, end): ``<band>_min`` and ``<band>_max``."""
    if begin is not None:
        df = df.filter((F.col(time) >= F.lit(begin)) & (F.col(time) < F.lit(end)))
    return df.groupBy(*keys).agg(*[a for b in bands for a in (
        F.min(b).alias(f"{b}_min"), F.max(b).alias(f"{b}_max"))])


def tile_vi_minmax(df: DataFrame, stats: DataFrame, vi: str, bands: dict, keys=("tile_id",)) -> DataFrame:
    """Range of an index per tile after scaling each band by the tile's stored range to [0, 1]."""
    joined = attach(df, stats, keys)
    for band, c in bands.items():
        scaled = rescale("normalization", F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max"))
        joined = joined.withColumn(f"_n_{band}", clip(scaled, F.lit(0.0), F.lit(1.0)))
    value = vegetation_index(vi, {band: f"_n_{band}" for band in bands})
    return joined.groupBy(*keys).agg(F.min(value).alias(f"{vi}_min"), F.max(value).alias(f"{vi}_max"))


def value_frequency(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with count and share of all rows."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    everything = counts.agg(F.sum("n").alias("n")).scalar()  # reads the same exchange as the counts
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), everything.cast("double")))


def histogram(df: DataFrame, value: str, bins: int, lo: float, hi: float, keys=()) -> DataFrame:
    """Equal-width counts over [lo, hi]; the last bin includes ``hi``, values outside are ignored."""
    v = F.col(value).cast("double")
    bin_no = F.least(F.width_bucket(v, F.lit(float(lo)), F.lit(float(hi)), F.lit(bins)), F.lit(bins).cast("long")) - 1
    kept = df.filter((v >= lo) & (v <= hi))
    return kept.groupBy(*keys, bin_no.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def class_histogram(df: DataFrame, value: str, n_classes: int, weights: DataFrame | None = None) -> DataFrame:
    """Share of each class 0..n-1, optionally divided by a per-class weight (``class_id``, ``weight``)."""
    # One row of n_classes counts and the total: one pass, nothing to join.
    v = F.col(value).cast("int")
    row = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(v == i).alias(f"_{i}") for i in range(n_classes)])
    each = F.array(*[F.struct(F.lit(i).alias("class_id"), F.col(f"_{i}").alias("n")) for i in range(n_classes)])
    out = row.select("_all", F.inline(each)).select(
        "class_id", "n", F.try_divide(F.col("n").cast("double"), F.col("_all").cast("double")).alias("share"))
    if weights is None:
        return out
    return out.join(weights, "class_id", "left").select(
        "class_id", "n", F.try_divide(F.col("share"), F.col("weight")).alias("share"))


def cluster_summary(df: DataFrame, label: str, value: str) -> DataFrame:
    """Per cluster: size and mean of a score (e.g. silhouette), next to the overall mean."""
    per = df.groupBy(label).agg(F.count(value).alias("n"), F.avg(value).alias("mean_value"), F.min(value).alias("min_value"),
                                F.max(value).alias("max_value"), F.sum(F.col(value).cast("double")).alias("_sum"))
    clusters = Window.partitionBy()  # one row for each cluster
    return per.withColumn("overall_mean", F.try_divide(F.sum("_sum").over(clusters), F.sum("n").over(clusters).cast("double"))
                          ).drop("_sum")


def silhouette_points(df: DataFrame, columns, label: str, name: str = "silhouette") -> DataFrame:
    """Silhouette of every row by squared Euclidean distance, without pairs of rows.

    The mean squared distance to a cluster follows from the cluster's count,
    sums and squared norms: one small row of statistics joins the rows once.
    Values are taken from the overall mean first, so that the differences keep
    their digits.  A row alone in its cluster, or with one cluster in all, has
    0; a row with a null value or label has null and does not take part.
    """
    columns = list(columns)
    used = F.col(label).isNotNull()
    for c in columns:
        used = used & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    whole = df.filter(used)
    middle = whole.agg(*[F.avg(c).alias(c) for c in columns]).select(F.array(*columns)).scalar()
    centred = F.zip_with(F.array(*[F.col(c).cast("double") for c in columns]), "_middle", lambda x, m: x - m)
    norm = F.aggregate("_x", F.lit(0.0), lambda a, x: a + x * x)
    placed = df.withColumn("_middle", middle).withColumn("_x", F.when(used, centred)).drop("_middle").withColumn("_q", norm)
    per = placed.filter("_x is not null").groupBy(F.col(label).alias("_l")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_q").alias("q"), F.array(*[F.sum(F.col("_x")[j]) for j in range(len(columns))]).alias("s"))
    # One entry for each cluster.
    table = per.agg(F.collect_list(F.struct("_l", "n", "q", "s"))).scalar()

    def total(c):
        dot = F.aggregate(F.zip_with("_x", c["s"], lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(c["n"] * F.col("_q") - 2 * dot + c["q"], F.lit(0.0))

    own = F.get(F.filter("_clusters", lambda c: c["_l"] == F.col(label)), F.lit(0))
    others = F.filter("_clusters", lambda c: c["_l"] != F.col(label))
    out = placed.withColumn("_clusters", table).withColumn("_n", own["n"]).withColumn("_a", F.try_divide(total(own), own["n"] - 1)).withColumn(
        "_b", F.array_min(F.transform(others, lambda c: total(c) / c["n"])))
    value = F.when((F.col("_n") == 1) | F.col("_b").isNull(), F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.greatest("_a", "_b")), F.lit(0.0)))
    return out.withColumn(name, F.when(F.col("_x").isNotNull(), value)).select(*df.columns, name)


def silhouette(df: DataFrame, features: str = "features", prediction: str = "prediction") -> float:
    """Overall silhouette of a clustering (squared Euclidean distance)."""
    return ClusteringEvaluator(featuresCol=features, predictionCol=prediction).evaluate(df)


def band_info(df: DataFrame, bands, nodata=None) -> DataFrame:
    """One row per band: type, pixel count, range and number of no-data pixels."""
    aggs = []
    for b in bands:
        missing = F.col(b).isNull() if nodata is None else (F.col(b).isNull() | (F.col(b) == nodata))
        aggs += [F.count(b).alias(f"{b}__n"), F.min(b).alias(f"{b}__a"), F.max(b).alias(f"{b}__b"),
                 F.count_if(missing).alias(f"{b}__x")]
    kinds = dict(df.dtypes)
    entries = [F.struct(F.lit(b).alias("band"), F.lit(kinds[b]).alias("data_type"), F.col(f"{b}__n").alias("n"),
                        F.col(f"{b}__a").cast("double").alias("min_value"),
                        F.col(f"{b}__b").cast("double").alias("max_value"), F.col(f"{b}__x").alias("n_missing"))
               for b in bands]
    return df.agg(*aggs).select(F.inline(F.array(*entries)))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of every frame, duplicates kept, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
