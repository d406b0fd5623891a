"""Raster blocks as arrays: neighbourhood passes and displacements without a row for each neighbour.

Pixels travel once to their block (and to the blocks whose border they lie in);
there a block is a dense array and every pass or shift is arithmetic on whole
arrays.  Blocks are bounded, so a task's memory is too.  Displaced values leave
a block as one partial array for each block that they reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from swathframe.operators.focal import _BC, _BR, BLOCK, with_halo
from swathframe.operators.layout import attach


def _changes(batch: pa.RecordBatch, names) -> np.ndarray:
    """Where a row's keys differ from those of the row before."""
    out = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in names:
        column = batch.column(batch.schema.get_field_index(name))
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out |= differs | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))
    return np.flatnonzero(out) + 1


def _same(a: pa.RecordBatch, b: pa.RecordBatch, names) -> bool:
    return all(a.column(i)[a.num_rows - 1].as_py() == b.column(i)[0].as_py() for i in (a.schema.get_field_index(n) for n in names))


def grouped(batches, names):
    """The rows of each group as one table; rows come sorted by ``names``, and a group is bounded."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = [0, *_changes(batch, names).tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            piece = batch.slice(lo, hi - lo)
            if held and not _same(held[-1], piece, names):
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _shifted(a: np.ndarray, dr: int, dc: int):
    """Slices of target and source for a displacement within an array."""
    h, w = a.shape
    return ((slice(max(dr, 0), h + min(dr, 0)), slice(max(dc, 0), w + min(dc, 0))),
            (slice(max(-dr, 0), h + min(-dr, 0)), slice(max(-dc, 0), w + min(-dc, 0))))


def fold_passes(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, valid: np.ndarray, passes) -> tuple[np.ndarray, np.ndarray]:
    """Values after all passes at the given pixels, and where there is one.

    A pass is ("min" or "max", offsets).  Absent pixels and nulls do not take
    part; a null pixel gets a value from its neighbours.
    """
    r, c = rows - rows.min(), cols - cols.min()
    shape = (int(r.max()) + 1, int(c.max()) + 1)
    present = np.zeros(shape, bool)
    present[r, c] = True
    have = np.zeros(shape, bool)
    have[r[valid], c[valid]] = True
    for fold, offsets in passes:
        take, empty = (np.fmin, np.nan) if fold == "min" else (np.maximum, -np.inf)
        old = np.full(shape, empty)
        if values.shape != shape:  # the first pass: pixels to an array, repeated ones folded
            take.at(old, (r[valid], c[valid]), values[valid])
        else:
            old[have] = values[have]
        new, reached = np.full(shape, empty), np.zeros(shape, bool)
        for dr, dc in offsets:
            if abs(dr) >= shape[0] or abs(dc) >= shape[1]:
                continue
            to, of = _shifted(old, -dr, -dc)
            new[to] = take(new[to], old[of])
            reached[to] |= have[of]
        values, have = new, reached & present
    return values[r, c], have[r, c]


def focal_passes(df: DataFrame, value: str, passes, reach: int, keys, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with ``name``: the passes of ``fold_passes`` over every image, exact across block borders.

    ``reach`` is the reach of all passes together.  Columns of ``df`` stay as
    they are and travel once.
    """
    base, groups = df.columns, [*keys, _BR, _BC]
    out = StructType([*df.schema.fields, StructField(name, DoubleType())])

    def run(batches):
        for table in grouped(batches, groups):
            rows, cols = (_numbers(table, x).astype(np.int64) for x in ("row", "col"))
            column = table.column("_focal")
            valid = column.is_valid().to_numpy()
            got, have = fold_passes(rows, cols, pc.fill_null(column, 0.0).to_numpy(), valid, passes)
            own = (rows // block == _numbers(table, _BR)) & (cols // block == _numbers(table, _BC))
            kept = table.select(base).append_column(name, pa.array(got, pa.float64(), mask=~have)).filter(pa.array(own))
            yield from kept.to_batches()

    halo = with_halo(df.withColumn("_focal", F.col(value).cast("double")), reach, keys, block)
    return halo.sortWithinPartitions(*groups).mapInArrow(run, out)


# --- displacement -------------------------------------------------------------------------------------------------

_PART = [StructField(n, IntegerType()) for n in (_BR, _BC, "top", "left", "height", "width")] + [
    StructField(n, BinaryType()) for n in ("sums", "weights", "values")]


def _cut(canvas, top: int, left: int, block: int):
    """(block row, block column, top, left, arrays) of the part of a canvas in each block it touches."""
    weights = canvas[1]
    for br in range(top // block, (top + weights.shape[0] - 1) // block + 1):
        for bc in range(left // block, (left + weights.shape[1] - 1) // block + 1):
            r0, c0 = max(br * block - top, 0), max(bc * block - left, 0)
            r1, c1 = (br + 1) * block - top, (bc + 1) * block - left
            used = weights[r0:r1, c0:c1] > 0
            if used.any():
                at_r, at_c = np.flatnonzero(used.any(axis=1)), np.flatnonzero(used.any(axis=0))
                part = (slice(r0 + at_r[0], r0 + at_r[-1] + 1), slice(c0 + at_c[0], c0 + at_c[-1] + 1))
                yield br, bc, top + part[0].start, left + part[1].start, [a[part] for a in canvas]


def displaced_parts(df: DataFrame, value: str, shifts: DataFrame, keys, block: int = BLOCK) -> DataFrame:
    """Weighted sums of ``value`` after displacement, as partial arrays by the block they fall in.

    ``shifts`` has one row per key with ``shifts``, an array of (dr, dc, w).
    Every pixel adds its value w times at (row + dr, col + dc).  Columns: keys,
    block, top, left, height, width, and as bytes the sums, the weights, and
    how many values are not null.
    """
    groups = [*keys, _BR, _BC]
    placed = df.select(*keys, "row", "col", F.col(value).cast("double").alias("_v"), F.floor(F.col("row") / block).cast("int").alias(_BR),
                       F.floor(F.col("col") / block).cast("int").alias(_BC)).repartition(*groups).sortWithinPartitions(*groups)
    kept = [df.schema[k] for k in keys]
    names = [*keys, *(f.name for f in _PART)]

    def pack(batches):
        for table in grouped(batches, groups):
            rows, cols = (_numbers(table, x).astype(np.int64) for x in ("row", "col"))
            r, c = rows - rows.min(), cols - cols.min()
            shape = (int(r.max()) + 1, int(c.max()) + 1)
            valid = table.column("_v").is_valid().to_numpy()
            arrays = [np.zeros(shape) for _ in range(3)]
            np.add.at(arrays[0], (r, c), pc.fill_null(table.column("_v"), 0.0).to_numpy())
            np.add.at(arrays[1], (r, c), 1.0)
            np.add.at(arrays[2], (r, c), valid.astype(float))
            first = table.slice(0, 1)
            yield pa.RecordBatch.from_arrays(
                [first.column(k).combine_chunks() for k in (*keys, _BR, _BC)]
                + [pa.array([int(x)], pa.int32()) for x in (rows.min(), cols.min(), *shape)]
                + [pa.array([a.tobytes()], pa.binary()) for a in arrays], names=names)

    def move(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(batch.schema.get_field_index(n))[at].as_py() for n in (*names, "shifts")}
                shape = (row["height"], row["width"])
                arrays = [np.frombuffer(row[n]).reshape(shape) for n in ("sums", "weights", "values")]
                drs, dcs = [s["dr"] for s in row["shifts"]], [s["dc"] for s in row["shifts"]]
                canvas = [np.zeros((shape[0] + max(drs) - min(drs), shape[1] + max(dcs) - min(dcs))) for _ in arrays]
                for s in row["shifts"]:
                    r, c = s["dr"] - min(drs), s["dc"] - min(dcs)
                    for to, a in zip(canvas, arrays):
                        to[r:r + shape[0], c:c + shape[1]] += s["w"] * a
                for br, bc, top, left, parts in _cut(canvas, row["top"] + min(drs), row["left"] + min(dcs), block):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(batch.schema.get_field_index(k)).slice(at, 1) for k in keys]
                        + [pa.array([int(x)], pa.int32()) for x in (br, bc, top, left, *parts[0].shape)]
                        + [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in parts], names=names)

    packed = placed.mapInArrow(pack, StructType([*kept, *_PART]))
    return attach(packed, shifts, keys, salt_by=(_BR, _BC)).mapInArrow(move, StructType([*kept, *_PART]))


def _total(parts: pa.Table, br: int, bc: int, block: int) -> list[np.ndarray]:
    out = [np.zeros((block, block)) for _ in range(3)]
    for row in parts.select([f.name for f in _PART]).to_pylist():
        r, c, shape = row["top"] - br * block, row["left"] - bc * block, (row["height"], row["width"])
        for total, n in zip(out, ("sums", "weights", "values")):
            total[r:r + shape[0], c:c + shape[1]] += np.frombuffer(row[n]).reshape(shape)
    return out


def displaced_mean(parts: DataFrame, keys, name: str, block: int = BLOCK) -> DataFrame:
    """(keys, row, col, ``name``) wherever a displaced value falls; null where all that fall there are null."""
    groups = [*keys, _BR, _BC]
    out = StructType([*(parts.schema[k] for k in keys), StructField("row", IntegerType()), StructField("col", IntegerType()),
                      StructField(name, DoubleType())])

    def run(batches):
        for table in grouped(batches, groups):
            br, bc = table.column(_BR)[0].as_py(), table.column(_BC)[0].as_py()
            sums, weights, values = _total(table, br, bc, block)
            r, c = np.nonzero(weights)
            mean = pa.array(sums[r, c] / weights[r, c], pa.float64(), mask=values[r, c] == 0)
            first = table.slice(0, 1)
            same = [pa.repeat(first.column(k)[0], len(r)) for k in keys]
            yield pa.RecordBatch.from_arrays([*same, pa.array((r + br * block).astype(np.int32)),
                                              pa.array((c + bc * block).astype(np.int32)), mean], names=out.names)

    return parts.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(run, out)


def with_displaced_mean(df: DataFrame, parts: DataFrame, keys, name: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the mean of what falls on each pixel; null where nothing does. Blocks meet, not pixels."""
    base, groups = df.columns, [*keys, _BR, _BC]
    placed = df.withColumn(_BR, F.floor(F.col("row") / block).cast("int")).withColumn(_BC, F.floor(F.col("col") / block).cast("int"))

    def run(left, right):
        if not left.num_rows:
            return left.select(base).append_column(name, pa.array([], pa.float64()))
        br, bc = left.column(_BR)[0].as_py(), left.column(_BC)[0].as_py()
        sums, weights, values = _total(right, br, bc, block)
        r, c = (_numbers(left, x).astype(np.int64) - b * block for x, b in (("row", br), ("col", bc)))
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = sums[r, c] / weights[r, c]
        return left.select(base).append_column(name, pa.array(mean, pa.float64(), mask=values[r, c] == 0))

    return placed.groupBy(*groups).cogroup(parts.groupBy(*groups)).applyInArrow(
        run, StructType([*df.schema.fields, StructField(name, DoubleType())]))
