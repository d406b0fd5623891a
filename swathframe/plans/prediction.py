"""From stored scalers and a model to a georeferenced mosaic of predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathframe.operators.grid import georeference, mosaic
from swathframe.operators.layout import attach
from swathframe.operators.normalise import apply_scaler
from swathframe.operators.scoring import score_pixels


def predict_mosaic(pixels: DataFrame, scalers: DataFrame, groups: dict, channels, build, out_channels, out_groups: dict,
                   tiles: DataFrame, res: float, block: int = 512, margin: int = 0) -> DataFrame:
    """normalise -> score -> scale back -> place on the map -> mosaic, as one plan.

    ``scalers`` are the stored rows of the training data; ``groups`` says which
    input columns each scales, ``out_groups`` which predicted columns it scales
    back.  ``tiles``: tile_id, x0, y0 of the upper-left cell and source_order;
    where tiles overlap the later one wins.
    """
    scaled = apply_scaler(pixels, scalers, groups)
    predicted = score_pixels(scaled, channels, build, out_channels, block, margin)
    back = apply_scaler(predicted, scalers, out_groups, invert=True)
    placed = georeference(back, tiles.select("tile_id", "x0", "y0"), res)
    ordered = attach(placed, tiles.select("tile_id", "source_order"), ["tile_id"])
    return mosaic(ordered.select("x", "y", "source_order", *out_channels), out_channels).select("x", "y", *[
        F.col(c) for c in out_channels])
