"""Apply a user-supplied model to whole tiles in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathframe.operators.layout import attach

PACKED = "tile_id {tile}, n_rows int, n_cols int, n_bands int, values array<float>"


def pack_tiles(pixels: DataFrame, channels, max_pixels: int = 1024 * 1024) -> DataFrame:
    """One row per tile: channel-last float array.

    A tile above ``max_pixels`` fails before anything is collected for it;
    ``score_pixels`` takes tiles of any size.
    """
    sizes = pixels.groupBy("tile_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"))
    checked = sizes.withColumn("n_rows", F.when(
        F.col("n_rows").cast("long") * F.col("n_cols") <= max_pixels, F.col("n_rows")).otherwise(F.raise_error(
            F.lit("a tile is too large to be scored in one piece: cut it first")).cast("int")))
    cells = F.array_sort(F.collect_list(F.struct(
        (F.col("row") * F.col("n_cols") + F.col("col")).alias("pos"),
        F.array(*[F.col(c).cast("float") for c in channels]).alias("v"))))
    return attach(pixels, checked, ["tile_id"]).groupBy("tile_id", "n_rows", "n_cols").agg(
        F.flatten(F.transform(cells, lambda s: s["v"])).alias("values")).select(
        "tile_id", F.col("n_rows").cast("int"), F.col("n_cols").cast("int"),
        F.lit(len(list(channels))).alias("n_bands"), "values")


def unpack_tiles(tiles: DataFrame, channels) -> DataFrame:
    """Packed tiles back to one row per pixel."""
    n = F.col("n_bands")
    cells = tiles.select("tile_id", "n_cols", "n_bands", "values", F.explode(
        F.sequence(F.lit(0), F.col("n_rows") * F.col("n_cols") - 1)).alias("_pos"))
    return cells.select("tile_id", F.floor(F.col("_pos") / F.col("n_cols")).cast("int").alias("row"),
                        (F.col("_pos") % F.col("n_cols")).cast("int").alias("col"),
                        *[F.get("values", F.col("_pos") * n + i).cast("double").alias(c) for i, c in enumerate(channels)])


def score_tiles(tiles: DataFrame, build, existing: DataFrame | None = None) -> DataFrame:
    """Score packed tiles with ``build()``, made once per task: ``fn(array HxWxC) -> array HxWxC'``.

    Tiles that are already in ``existing`` are taken from there.
    """
    tile_type = dict(tiles.dtypes)["tile_id"]
    todo = tiles if existing is None else tiles.join(existing.select("tile_id"), "tile_id", "left_anti")

    def run(batches):
        fn = None
        for pdf in batches:
            fn = fn or build()
            for r in pdf.itertuples(index=False):
                cube = np.asarray(r.values, dtype="float32").reshape(r.n_rows, r.n_cols, r.n_bands)
                out = np.asarray(fn(cube), dtype="float32")
                yield pd.DataFrame({"tile_id": [r.tile_id], "n_rows": [out.shape[0]], "n_cols": [out.shape[1]],
                                    "n_bands": [out.shape[2]], "values": [out.ravel()]})

    scored = todo.mapInPandas(run, PACKED.format(tile=tile_type))
    return scored if existing is None else existing.select(*scored.columns).unionByName(scored)


def score_pixels(pixels: DataFrame, channels, build, out_channels, block: int = 512, margin: int = 0) -> DataFrame:
    """Score tiles of any size in blocks of ``block`` pixels with ``margin`` pixels around them.

    The result equals scoring whole tiles if the model looks no further than
    ``margin``.  A pixel near a block's edge goes to each block that sees it, in
    one shuffle; a block is all that a task holds at a time.  Absent pixels
    inside a block are NaN, and only pixels that exist are returned.
    """
    def reach(c):
        return F.sequence(F.greatest(F.floor((F.col(c) - margin) / block), F.lit(0)), F.floor((F.col(c) + margin) / block))

    tile_type, names = dict(pixels.dtypes)["tile_id"], list(out_channels)
    seen = pixels.select("tile_id", "row", "col", F.array(*[F.col(c).cast("float") for c in channels]).alias("v"),
                         F.explode(reach("row")).alias("i")).select("tile_id", "row", "col", "v", "i",
                                                                         F.explode(reach("col")).alias("j"))
    blocks = seen.groupBy("tile_id", "i", "j").agg(F.collect_list(F.struct("row", "col", "v")).alias("cells"))

    def run(batches):
        fn = None
        for pdf in batches:
            fn = fn or build()
            for r in pdf.itertuples(index=False):
                at = np.array([(c["row"], c["col"]) for c in r.cells])
                lo = at.min(axis=0)
                cube = np.full((*(at.max(axis=0) - lo + 1), len(r.cells[0]["v"])), np.nan, "float32")
                cube[tuple((at - lo).T)] = np.array([c["v"] for c in r.cells], "float32")
                out = np.asarray(fn(cube), dtype="float64")
                own = at[(at[:, 0] // block == r.i) & (at[:, 1] // block == r.j)]
                values = out[tuple((own - lo).T)]
                yield pd.DataFrame({"tile_id": r.tile_id, "row": own[:, 0], "col": own[:, 1],
                                    **{n: values[:, k] for k, n in enumerate(names)}})

    return blocks.mapInPandas(run, f"tile_id {tile_type}, row int, col int, " + ", ".join(f"{n} double" for n in names))
