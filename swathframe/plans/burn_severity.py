"""Burn-severity evaluation of predicted images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathframe.functions.indices import vegetation_index
from swathframe.operators.confusion import class_error_rate, confusion_matrix, normalize_confusion, severity_maps

PRE = {"R": "r_t0", "G": "g_t0", "B": "b_t0", "NIR": "nir_t0"}
POST = {"R": "r_t1", "G": "g_t1", "B": "b_t1", "NIR": "nir_t1"}
PREDICTED = {"R": "r_pred", "G": "g_pred", "B": "b_pred", "NIR": "nir_pred"}


def severity_confusion(pixels: DataFrame, vi: str = "ndvi", pre=None, post=None, predicted=None,
                       keep=("tile_id",)) -> DataFrame:
    """Confusion matrix of true and predicted burn classes."""
    maps = severity_maps(pixels, pre or PRE, post or POST, predicted or PREDICTED, vi, keep)
    return confusion_matrix(maps)


def severity_report(pixels: DataFrame, vi: str = "ndvi", **bands) -> DataFrame:
    return normalize_confusion(severity_confusion(pixels, vi, **bands), axis=1)


def vi_report(pixels: DataFrame, vi: str = "ndvi", pre=None, post=None, predicted=None,
              keep=("tile_id", "row", "col")) -> DataFrame:
    """Index before, after and predicted, with both differences."""
    values = {"vi_pre": pre or PRE, "vi_true": post or POST, "vi_pred": predicted or PREDICTED}
    out = pixels.select(*keep, *[vegetation_index(vi, b).alias(n) for n, b in values.items()])
    return out.withColumn("d_true", F.col("vi_pre") - F.col("vi_true")).withColumn(
        "d_pred", F.col("vi_pre") - F.col("vi_pred"))


def landclass_error_rates(pixels: DataFrame, class_col: str, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return class_error_rate(pixels, class_col, F.col(truth) != F.col(predicted))
