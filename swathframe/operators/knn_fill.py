"""Nearest-row imputation of missing pixels.

Inside one tile and band, image rows are samples and columns are features: a
missing cell takes the mean of its column over the ``k`` nearest rows that
have the column.  The distance skips missing coordinates and scales by
``columns / shared columns``.

Distances are needed between the rows that miss something and the rows of the
same tile.  A tile is cut into blocks of rows and columns.  Each (receiver
chunk, donor chunk, column block) is a task of bounded size that returns partial
squared distances; these are summed over the column blocks, go back to the
column blocks with gaps, and at most ``k`` candidates per missing cell meet in
one aggregate.  No task holds a whole image row.  Tiles and bands without a gap
never enter.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from swathframe.operators.block_arrays import grouped
from swathframe.operators.layout import attach
from swathframe.session import write_once

CHUNK_ROWS = CHUNK_COLUMNS = 256
_IMAGE = ["tile_id", "band"]


def _fields(kind, *names) -> list[StructField]:
    return [StructField(n, kind) for n in names]


def _dense(values: bytes, exists: bytes, shape: tuple[int, int], full: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Values with NaN for missing and which cells exist, padded to the full size of the block."""
    out, known = np.full(full, np.nan), np.zeros(full, bool)
    out[:shape[0], :shape[1]] = np.frombuffer(values).reshape(shape)
    known[:shape[0], :shape[1]] = np.frombuffer(exists, bool).reshape(shape)
    return out, known


def _blocks(df: DataFrame, columns, chunk: int, width: int) -> DataFrame:
    """(tile_id, band, chunk, cb, values, exists, height, width): every band of every tile as dense blocks."""
    cells = df.select("tile_id", "row", "col", F.explode(F.array(*[
        F.struct(F.lit(c).alias("band"), F.col(c).cast("double").alias("value")) for c in columns])).alias("_e"))
    groups = [*_IMAGE, "chunk", "cb"]
    placed = cells.select("tile_id", "_e.band", F.floor(F.col("row") / chunk).cast("int").alias("chunk"),
                          F.floor(F.col("col") / width).cast("int").alias("cb"), "row", "col", "_e.value")
    schema = StructType([placed.schema[g] for g in groups] + _fields(BinaryType(), "values", "exists")
                        + _fields(IntegerType(), "height", "width") + _fields(ArrayType(IntegerType()), "gap_rows"))

    def pack(batches):
        for table in grouped(batches, groups):
            r, c = table.column("row").to_numpy() % chunk, table.column("col").to_numpy() % width
            values = np.full((int(r.max()) + 1, int(c.max()) + 1), np.nan)
            exists = np.zeros(values.shape, bool)
            exists[r, c] = True
            values[r, c] = pc.fill_null(table.column("value"), np.nan).to_numpy()
            first = table.slice(0, 1)
            yield pa.RecordBatch.from_arrays(
                [*(first.column(g).combine_chunks() for g in groups), pa.array([values.tobytes()], pa.binary()),
                 pa.array([exists.tobytes()], pa.binary()), *(pa.array([n], pa.int32()) for n in values.shape),
                 pa.array([np.flatnonzero((exists & np.isnan(values)).any(axis=1)).tolist()], pa.list_(pa.int32()))], names=schema.names)

    return placed.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(pack, schema)


def _each(batches):
    """Rows of a batch as dictionaries, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1), {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def _streams(batches, names):
    """The rows of each group as an iterator; rows come sorted by group, and only one is held at a time."""
    rows = ((tuple(row[n] for n in names), batch, row) for batch, row in _each(batches))
    for _, group in itertools.groupby(rows, key=lambda x: x[0]):
        yield ((batch, row) for _, batch, row in group)


def _first(batch: pa.RecordBatch, names) -> list:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]


def _sizes(row: dict, chunk: int, width: int) -> tuple[int, int, int]:
    """Rows of the receiver chunk and of the donor chunk, columns of the block."""
    rows = row["_last_row"] + 1
    return (min(chunk, rows - row["rc"] * chunk), min(chunk, rows - row["dc"] * chunk),
            min(width, row["_last_col"] + 1 - row["cb"] * width))


def candidates(a: np.ndarray, exists: np.ndarray, b: np.ndarray, dist: np.ndarray, k: int):
    """(row, column, distance, donor, value, column sum, column count) of the first ``k`` donors of each missing cell."""
    have = ~np.isnan(b)
    sums, counts = np.where(have, b, 0.0).sum(axis=0), have.sum(axis=0)
    out = []
    for i in np.flatnonzero((exists & np.isnan(a)).any(axis=1)):
        order = np.argsort(dist[i], kind="stable")  # NaN sorts last, equal distances by donor row
        missing = np.flatnonzero(exists[i] & np.isnan(a[i]))
        usable = have[np.ix_(order, missing)]
        rank = usable.cumsum(axis=0)
        at, which = np.nonzero(usable & (rank <= k))
        donor, col = order[at], missing[which]
        once = rank[at, which] == 1  # column totals ride on the first candidate only
        out.append((np.full(len(col), i), col, dist[i, donor], donor, b[donor, col], np.where(once, sums[col], 0.0),
                    np.where(once, counts[col], 0)))
    return [np.concatenate(c) for c in zip(*out)] if out else None


def knn_fill(df: DataFrame, columns, k: int = 5, chunk: int = CHUNK_ROWS, width: int = CHUNK_COLUMNS) -> DataFrame:
    """Fill NULLs of ``columns``; a column missing in the whole tile stays NULL.

    The dense blocks are stored once: they are read as receivers and donors,
    for the distances and for the values.
    """
    columns = list(columns)
    keys = ["tile_id", "row", "col"]
    tiles = df.groupBy("tile_id").agg(
        F.max("row").cast("int").alias("_last_row"), F.max("col").cast("int").alias("_last_col"),
        # The chunks of each column that have gaps: at most one for each ``chunk`` rows.
        *[F.collect_set(F.when(F.col(c).isNull(), F.floor(F.col("row") / chunk).cast("int"))).alias(f"_at_{i}")
          for i, c in enumerate(columns)])
    gappy = tiles.select("tile_id", "_last_row", "_last_col", F.inline(F.array(*[
        F.struct(F.lit(c).alias("band"), F.col(f"_at_{i}").alias("_at")) for i, c in enumerate(columns)]))).filter(
        F.size("_at") > 0)
    blocks = write_once(attach(_blocks(df, columns, chunk, width), gappy, _IMAGE, salt_by=["chunk", "cb"]))
    image = StructType([blocks.schema[n] for n in _IMAGE])
    chunks = F.sequence(F.lit(0), F.floor(F.col("_last_row") / chunk).cast("int"))
    pair, spot = [*_IMAGE, "rc", "dc"], [*_IMAGE, "rc", "dc", "cb"]
    # Every key of the joins below has one row on either side, so a large tile spreads evenly.
    need = blocks.filter(F.size("gap_rows") > 0).groupBy(*_IMAGE, "chunk").agg(  # the rows of a chunk at most
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("gap_rows")))).alias("need"))
    mine = blocks.join(need, [*_IMAGE, "chunk"]).select(
        *_IMAGE, F.col("chunk").alias("rc"), F.explode(chunks).alias("dc"), "cb", "_last_row", "_last_col", "need",
        (F.size("gap_rows") > 0).alias("has_gap"), F.struct("values", "exists", "height", "width").alias("own"))
    others = blocks.select(*_IMAGE, F.explode("_at").alias("rc"), F.col("chunk").alias("dc"), "cb",
                           F.struct("values", "exists", "height", "width").alias("other"))

    def pieces(row):
        nr, nd, w = _sizes(row, chunk, width)
        read = lambda x, n: _dense(x["values"], x["exists"], (x["height"], x["width"]), (n, w))
        own, exists = read(row["own"], nr)
        return own[row["need"]], exists[row["need"]], read(row["other"], nd)[0]

    def partial(batches):
        for batch, row in _each(batches):
            a, _, b = pieces(row)
            shared = (~np.isnan(a)).astype(float) @ (~np.isnan(b)).astype(float).T
            square = np.stack([np.nansum((b - one) ** 2, axis=1) for one in a])  # differences, so that equal rows tie exactly
            yield pa.RecordBatch.from_arrays([*_first(batch, [*spot, "_last_row", "_last_col"]), pa.array([square.tobytes()], pa.binary()),
                                              pa.array([shared.tobytes()], pa.binary())], names=part.names)

    part = StructType([*image.fields, *_fields(IntegerType(), "rc", "dc", "cb", "_last_row", "_last_col"),
                       *_fields(BinaryType(), "square", "shared")])

    def add(batches):
        """Partial distances of a chunk pair come one after the other."""
        for table in _streams(batches, pair):
            square = shared = 0.0
            for batch, row in table:
                square, shared = square + np.frombuffer(row["square"]), shared + np.frombuffer(row["shared"])
            dist = np.full(len(square), np.nan)
            np.sqrt(np.divide(square * (row["_last_col"] + 1), shared, out=dist, where=shared > 0), out=dist, where=shared > 0)
            yield pa.RecordBatch.from_arrays([*_first(batch, pair), pa.array([dist.tobytes()], pa.binary())], names=[*pair, "dist"])

    # All column blocks tell a chunk pair's distances; only those with a gap ask for them again.
    squares = mine.drop("has_gap").join(others, spot).mapInArrow(partial, part)
    far = squares.repartition(*pair).sortWithinPartitions(*spot).mapInArrow(
        add, StructType([*image.fields, *_fields(IntegerType(), "rc", "dc"), *_fields(BinaryType(), "dist")]))

    def choose(batches):
        for batch, row in _each(batches):
            a, exists, b = pieces(row)
            if found := candidates(a, exists, b, np.frombuffer(row["dist"]).reshape(len(a), len(b)), k):
                i, col, dist, donor, value, total, count = found
                same = [pa.repeat(c[0], len(i)) for c in _first(batch, _IMAGE)]
                yield pa.RecordBatch.from_arrays([*same, *map(pa.array, (
                    (np.array(row["need"])[i] + row["rc"] * chunk).astype(np.int32), (col + row["cb"] * width).astype(np.int32), dist,
                    (donor + row["dc"] * chunk).astype(np.int32), value, total, count.astype(np.int64)))], names=result.names)

    result = StructType([*image.fields, *_fields(IntegerType(), "row", "col"), *_fields(DoubleType(), "dist"), *_fields(IntegerType(), "donor"),
                         *_fields(DoubleType(), "value", "column_sum"), *_fields(LongType(), "column_n")])
    found = mine.filter("has_gap").join(others, spot).join(far, pair).mapInArrow(choose, result)
    rank = F.struct((F.col("dist").isNull() | F.isnan("dist")).alias("far"), "dist", "donor", "value")
    best = found.groupBy("tile_id", "band", "row", "col").agg(
        F.slice(F.array_sort(F.collect_list(rank)), 1, k).alias("near"),
        F.try_divide(F.sum("column_sum"), F.sum("column_n")).alias("column_mean"))
    mean = F.aggregate("near", F.lit(0.0), lambda s, n: s + n["value"]) / F.size("near")
    # No comparable row at all: the column mean of the tile.
    fills = best.select("tile_id", "row", "col", "band", F.when(
        F.get("near", F.lit(0))["far"], F.col("column_mean")).otherwise(mean).alias("fill"))
    wide = fills.groupBy(*keys).agg(*[F.max(F.when(F.col("band") == c, F.col("fill"))).alias(f"_fill_{i}")
                                      for i, c in enumerate(columns)])
    position = {c: i for i, c in enumerate(columns)}
    return df.join(wide, keys, "left").select(*[
        F.coalesce(F.col(c), F.col(f"_fill_{position[c]}")).alias(c) if c in position else F.col(c)
        for c in df.columns])
