"""Confusion matrices, class shares and class error rates.

Everything after the first aggregate works on at most (classes x classes)
rows; the pixel side is read once and combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swathframe.constants import CHANGE_THRESHOLD, N_LAND_CLASSES
from swathframe.functions.classes import fire_severity
from swathframe.functions.common import as_col
from swathframe.functions.indices import vi_difference
from swathframe.operators.layout import attach


def severity_maps(df: DataFrame, pre: dict, truth: dict, predicted: dict, vi: str = "ndvi",
                  keep=("tile_id", "row", "col")) -> DataFrame:
    """Burn class from the true and from the predicted image."""
    return df.select(*keep, fire_severity(vi_difference(vi, pre, truth)).alias("truth"),
                     fire_severity(vi_difference(vi, pre, predicted)).alias("predicted"))


def confusion_counts(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Counts for every pair of labels in the sorted union of both sides, zeros included.

    Rows without a class on either side are not counted.
    """
    counts = confusion_counts(df, truth, predicted).filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    # At most classes x classes rows from here on: one row holds them all, so nothing is read twice or joined.
    whole = counts.agg(F.sort_array(F.array_union(F.collect_set(truth), F.collect_set(predicted))).alias("_labels"),
                       F.map_from_entries(F.collect_list(F.struct(F.struct(F.col(truth).alias("t"), F.col(predicted).alias("p")), "n"))).alias("_n"))
    pairs = whole.select("_n", "_labels", F.explode("_labels").alias(truth)).select(
        "_n", truth, F.explode("_labels").alias(predicted))
    n = F.try_element_at("_n", F.struct(F.col(truth).alias("t"), F.col(predicted).alias("p")))
    return pairs.select(truth, predicted, F.coalesce(n, F.lit(0)).cast("long").alias("n"))


def confusion_wide(matrix: DataFrame, classes, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """One row per true class, one column ``pred_<class>`` per predicted class."""
    return matrix.groupBy(truth).agg(*[
        F.coalesce(F.sum(F.when(F.col(predicted) == c, F.col("n"))), F.lit(0)).cast("long").alias(
            f"pred_{c}" if c >= 0 else f"pred_m{-c}") for c in classes])


def normalize_confusion(matrix: DataFrame, axis: int = 0, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Share of the column sum (axis 0) or the row sum (axis 1); NULL for an empty sum."""
    by = predicted if axis == 0 else truth
    share = F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(by)).cast("double"))
    return matrix.withColumn("share", share)


def confusion_summary(matrix: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Macro recall (row-normalised diagonal) and macro precision (column-normalised diagonal)."""
    rows = F.sum("n").over(Window.partitionBy(truth)).cast("double")
    cols = F.sum("n").over(Window.partitionBy(predicted)).cast("double")
    diagonal = matrix.withColumn("_r", F.try_divide(F.col("n"), rows)).withColumn(
        "_p", F.try_divide(F.col("n"), cols)).filter(F.col(truth) == F.col(predicted))
    return diagonal.agg(F.avg("_r").alias("macro_recall"), F.avg("_p").alias("macro_precision"))


def class_shares(df: DataFrame, value: str = "truth") -> DataFrame:
    """Count and share of each value; the total is the sum of the few grouped counts, not a second pass."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    everything = F.sum("n").over(Window.partitionBy()).cast("double")  # one row for each class
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), everything))


def landclass_shares(df: DataFrame, value: str = "class_id", n_classes: int = N_LAND_CLASSES, keys=("tile_id",)) -> DataFrame:
    """Share of each class per tile, one column ``class_<i>`` each (missing is 0)."""
    v = F.col(value)
    return df.groupBy(*keys).agg(*[
        F.try_divide(F.count_if(v == i).cast("double"), F.count(F.lit(1)).cast("double")).alias(f"class_{i}")
        for i in range(n_classes)])


def top_landclasses(shares: DataFrame, k: int = 3, n_classes: int = N_LAND_CLASSES, keys=("tile_id",)) -> DataFrame:
    """The ``k`` largest shares per tile, rounded to 3 digits; the lower class id wins a tie.

    The shares already sit in one row per tile, so ranking them is an array sort.
    """
    entries = F.array(*[F.struct((-F.col(f"class_{i}")).alias("neg"), F.lit(i).alias("class_id"))
                        for i in range(n_classes)])
    best = F.slice(F.array_sort(entries), 1, k)
    return shares.select(*keys, F.posexplode(best).alias("pos", "e")).select(
        *keys, (F.col("pos") + 1).alias("rank"), F.col("e.class_id").alias("class_id"),
        F.round(-F.col("e.neg"), 3).alias("share"))


def class_errors(df: DataFrame, class_col: str, is_error, n_classes: int = N_LAND_CLASSES) -> DataFrame:
    """(class_id, n, n_error) in one pass over the pixels: every class 0..n-1, and whatever else the pixels hold.

    Pixels with another class or none keep a row of their own, so the counts
    add up to all pixels.
    """
    wrong = as_col(is_error)
    counts = df.groupBy(F.col(class_col).cast("int").alias("class_id")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("n_error"))
    every = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("class_id"), F.lit(0).cast("long").alias("n"),
                                                    F.lit(0).cast("long").alias("n_error"))
    return every.unionByName(counts).groupBy("class_id").agg(F.sum("n").alias("n"), F.sum("n_error").alias("n_error"))


def class_error_rate(df: DataFrame, class_col: str, is_error, n_classes: int = N_LAND_CLASSES) -> DataFrame:
    """Error pixels of a class over all pixels of the class, 0 when absent."""
    rate = F.coalesce(F.try_divide(F.col("n_error").cast("double"), F.col("n").cast("double")), F.lit(0.0))
    return class_errors(df, class_col, is_error, n_classes).withColumn("error_rate", rate)


def class_error_lift(df: DataFrame, class_col: str, is_error, n_classes: int = N_LAND_CLASSES) -> DataFrame:
    """Share of a class among the errors over its share overall; NULL when the class is absent."""
    counts = class_errors(df, class_col, is_error, n_classes)
    everything = Window.partitionBy()  # at most n_classes rows
    share_error = F.try_divide(F.col("n_error").cast("double"), F.sum("n_error").over(everything).cast("double"))
    share_all = F.try_divide(F.col("n").cast("double"), F.sum("n").over(everything).cast("double"))
    return counts.select("class_id", F.try_divide(share_error, share_all).alias("lift"))


def changed_tiles(df: DataFrame, difference, threshold: float = CHANGE_THRESHOLD, keys=("tile_id",)) -> DataFrame:
    """(keys, changed): false exactly where the tile's median difference is below the threshold.

    Whether a median lies below a threshold follows from the count below it and
    the two values around it, so no tile is sorted or collected.  A tile with a
    missing difference has no median and counts as changed.
    """
    d = as_col(difference)
    below = d < F.lit(threshold)
    s = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(below).alias("_lt"),
        F.count_if(d.isNull() | F.isnan(d)).alias("_missing"),
        F.max(F.when(below, d)).alias("_lo"), F.min(F.when(~below, d)).alias("_hi"))
    twice = 2 * F.col("_lt")
    unchanged = (twice > F.col("_n")) | ((twice == F.col("_n")) & ((F.col("_lo") + F.col("_hi")) / 2 < F.lit(threshold)))
    return s.select(*keys, (~F.coalesce(unchanged, F.lit(False)) | (F.col("_missing") > 0)).alias("changed"))


def keep_changed_tiles(df: DataFrame, changed: DataFrame, keys=("tile_id",)) -> DataFrame:
    return attach(df, changed.filter("changed").select(*keys), keys)


def mask_values(df: DataFrame, mask) -> DataFrame:
    return df.filter(as_col(mask))


