"""Neighbourhood operators over the pixel grid.

A tile may be a whole mosaic, so a window partitioned by tile alone would put
all of it in one task.  ``with_halo`` cuts every tile into square blocks and
copies the pixels near a block edge into the neighbouring blocks; afterwards
each block is independent and of bounded size.  One shuffle on (tile, block)
serves every pass that follows: the row windows, the column windows and
aggregates inside a block all reuse it.  The border is a small fraction of a
block (8 percent for an 11 x 11 window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swathframe.functions.common import as_col
from swathframe.operators.layout import attach

BLOCK = 256
_BR, _BC = "_block_row", "_block_col"


def _spread(df: DataFrame, axis: str, block_col: str, radius: int, block: int, extent: str | None) -> DataFrame:
    """Copies of each pixel along one axis: (position, block) pairs that need it.

    With ``extent`` (mirrored edges) the pixel also appears at its reflections
    in the border of width ``radius``.
    """
    pos = F.col(axis)

    def blocks(p):
        first = F.greatest(F.floor((p - radius) / block), F.lit(0)).cast("int")
        last = F.floor((p + radius) / block).cast("int")
        if extent is not None:
            last = F.least(last, F.floor((F.col(extent) - 1) / block).cast("int"))
        return F.sequence(first, last)

    if extent is None:
        return df.withColumn(block_col, F.explode(blocks(pos)))
    n = F.col(extent)
    turns = F.sequence(-F.floor(F.lit(radius) / (2 * n)).cast("int") - 1, F.floor(F.lit(radius) / (2 * n)).cast("int") + 1)
    images = F.flatten(F.transform(turns, lambda m: F.array(pos + 2 * n * m, -1 - pos + 2 * n * m)))
    needed = F.filter(images, lambda p: (p >= -radius) & (p < n + radius))
    placed = F.flatten(F.transform(needed, lambda p: F.transform(
        blocks(p), lambda b: F.struct(p.cast("int").alias("p"), b.alias("b")))))
    return (df.withColumn("_at", F.explode(placed)).withColumn(axis, F.col("_at.p"))
            .withColumn(block_col, F.col("_at.b")).drop("_at"))


def tile_extent(df: DataFrame, keys=("tile_id",)) -> DataFrame:
    return df.groupBy(*keys).agg((F.max("row") + 1).alias("_n_rows"), (F.max("col") + 1).alias("_n_cols"))


def with_halo(df: DataFrame, radius: int, keys=("tile_id",), block: int = BLOCK, mirror: bool = False,
              shape: tuple[int, int] | None = None) -> DataFrame:
    """Pixels partitioned by (tile, block), each block with its border of width ``radius``.

    ``mirror`` adds reflected pixels outside the image (edge pixel repeated).
    ``shape`` avoids the extent aggregate when all tiles have one size.
    """
    extents = (None, None)
    if mirror:
        extents = ("_n_rows", "_n_cols")
        if shape is not None:
            df = df.withColumn("_n_rows", F.lit(shape[0])).withColumn("_n_cols", F.lit(shape[1]))
        else:
            df = attach(df, tile_extent(df, keys), keys)
    out = _spread(df, "row", _BR, radius, block, extents[0])
    out = _spread(out, "col", _BC, radius, block, extents[1])
    return out.repartition(*keys, _BR, _BC)


def _fill_rows(df: DataFrame, values, lo: int, hi: int, keys, block: int) -> DataFrame:
    """Add empty positions beside gaps, so arrays along a row exist wherever a column needs them.

    The row pass stores its result at pixels; where a pixel is absent the
    column pass would miss the neighbours of that row.  Each pixel next to a
    gap (or an edge) adds the positions its value reaches inside its block;
    complete rows add none.  Added rows have NULL values and ``_real`` false.
    """
    order = Window.partitionBy(*keys, _BR, _BC, "row").orderBy("col")
    col, first, last = F.col("col"), F.col(_BC) * block, F.col(_BC) * block + (block - 1)
    out = df.withColumn("_prev", F.lag("col").over(order)).withColumn("_next", F.lead("col").over(order))
    after = F.least(col - lo, F.col("_next") - 1, last)
    before = F.greatest(col - hi, F.col("_prev") - lo + 1, first)
    none = F.expr("cast(array() as array<int>)")
    places = F.concat(F.array(col), F.when(after > col, F.sequence(col + 1, after)).otherwise(none),
                      F.when(before < col, F.sequence(before, col - 1)).otherwise(none))
    complete = (F.col("_next") == col + 1) & (F.col("_prev") == col - 1)
    out = out.withColumn("_place", F.explode(F.when(complete, F.array(col)).otherwise(places)))
    real = F.col("_place") == col
    hidden = {v: F.when(real, F.col(v)) for v in values}
    return out.withColumns({**hidden, "_real": real}).withColumn("col", F.col("_place")).drop("_prev", "_next", "_place")


def _owned(df: DataFrame, block: int, mirror: bool) -> DataFrame:
    """Drop the halo again: keep a pixel only in the block it belongs to."""
    own = (F.floor(F.col("row") / block) == F.col(_BR)) & (F.floor(F.col("col") / block) == F.col(_BC))
    if mirror:
        own = own & (F.col("row") >= 0) & (F.col("row") < F.col("_n_rows")) \
            & (F.col("col") >= 0) & (F.col("col") < F.col("_n_cols"))
    if "_real" in df.columns:
        own = own & F.col("_real")
    return df.filter(own).drop(_BR, _BC, "_n_rows", "_n_cols", "_real")


def _windows(keys, lo_c: int, hi_c: int, lo_r: int, hi_r: int):
    across = Window.partitionBy(*keys, _BR, _BC, "row").orderBy("col").rangeBetween(lo_c, hi_c)
    down = Window.partitionBy(*keys, _BR, _BC, "col").orderBy("row").rangeBetween(lo_r, hi_r)
    return across, down


def _carried(dtypes, columns) -> list[Column]:
    """Columns of the pixel itself (``_real``), brought through an aggregate over its neighbours."""
    plain = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "timestamp", "date")
    kinds = dict(dtypes)
    return [F.expr(f"max(if(_real, `{c}`, null)) as `{c}`" if kinds[c] in plain
                   else f"first(if(_real, `{c}`, null), true) as `{c}`") for c in columns]


def _gather(src: DataFrame, folds: dict, offsets, keys, block: int, carry, margin: int = 0) -> DataFrame:
    """Every pixel sends its values to the pixels that have it as a neighbour; equal targets are folded.

    ``folds`` maps a column to its aggregate.  The expansion happens after the
    shuffle and the aggregate is by (block, row, col), so it stays in the task,
    in generated code and without a sort.  Positions that hold no pixel also
    get a value (``_real`` false), as a later pass may need it.
    """
    moves = ", ".join(f"named_struct('dr', {-dr}, 'dc', {-dc})" for dr, dc in offsets)
    limits = " and ".join(
        f"{axis} >= {own} * {block} - {margin} and {axis} < ({own} + 1) * {block} + {margin}"
        for axis, own, i in (("row", _BR, 0), ("col", _BC, 1)) if any(o[i] for o in offsets)) or "true"
    out = src.selectExpr("*", f"explode(array({moves})) as _m").selectExpr(
        *[f"`{c}`" for c in [*keys, _BR, _BC, *carry, *folds]], "row + _m.dr as row", "col + _m.dc as col",
        "_real and _m.dr = 0 and _m.dc = 0 as _real").filter(limits)
    return out.groupBy(*keys, _BR, _BC, "row", "col").agg(
        F.expr("max(_real) as _real"), *_carried(src.dtypes, carry),
        *[F.expr(f"{fold}(`{c}`) as `{c}`") for c, fold in folds.items()])


def focal_square(df: DataFrame, values: dict, agg: str, radius: int, keys=("tile_id",),
                 block: int = BLOCK, counts: bool = False) -> DataFrame:
    """Statistic over a (2r+1) square: ``mean``, ``sum``, ``min`` or ``max``.

    ``values`` maps an output name to a Column over ``df``.  Pixels outside the
    image, absent or NULL do not take part.  ``counts`` adds ``<name>_n``.
    Squares separate: 2r+1 columns first, then 2r+1 rows.
    """
    if agg not in ("mean", "sum", "min", "max"):
        raise ValueError(f"unknown focal aggregate {agg!r}")
    base, names = df.columns, list(values)
    carry = [c for c in base if c not in (*keys, "row", "col")]
    fold = "sum" if agg == "mean" else agg
    columns = [as_col(c).alias(f"_v_{n}") for n, c in values.items()]
    folds = {f"_v_{n}": fold for n in names}
    if counts or agg == "mean":
        columns += [F.when(as_col(c).isNotNull(), 1).otherwise(0).alias(f"_k_{n}") for n, c in values.items()]
        folds.update({f"_k_{n}": "sum" for n in names})
    src = with_halo(df.select("*", *columns, F.lit(True).alias("_real")), radius, keys, block)
    reach = range(-radius, radius + 1)
    src = _gather(src, folds, [(0, d) for d in reach], keys, block, carry)
    src = _gather(src, folds, [(d, 0) for d in reach], keys, block, carry)
    out = []
    for n in names:
        total = F.col(f"_v_{n}")
        out.append((F.try_divide(total, F.col(f"_k_{n}")) if agg == "mean" else total).alias(n))
        if counts:
            out.append(F.col(f"_k_{n}").alias(f"{n}_n"))
    return _owned(src, block, mirror=False).select(*base, *out)


def square_runs(radius: int) -> dict[int, tuple[int, int]]:
    return {d: (-radius, radius) for d in range(-radius, radius + 1)}


def circle_runs(radius: float) -> dict[int, tuple[int, int]]:
    """Row offset -> column run of a disc of the given radius in pixels."""
    runs = {}
    for d in range(-int(radius), int(radius) + 1):
        half = int((radius * radius - d * d) ** 0.5)
        runs[d] = (-half, half)
    return runs


def diamond_runs(radius: int) -> dict[int, tuple[int, int]]:
    return {d: (-(radius - abs(d)), radius - abs(d)) for d in range(-radius, radius + 1)}


def run_offsets(runs) -> list[tuple[int, int]]:
    return [(d, c) for d, (lo, hi) in sorted(runs.items()) for c in range(lo, hi + 1)]


def focal_runs(df: DataFrame, values: dict, agg: str, runs: dict[int, tuple[int, int]], keys=("tile_id",),
               block: int = BLOCK, mirror: bool = False, shape=None) -> DataFrame:
    """Statistic over any footprint given as one column run per row offset.

    ``min``/``max``/``sum`` fold the neighbours in an aggregate.  ``median``
    reduces them as an array and ``collect`` returns that array in row-major
    order; both use window passes, which keep the order and can mirror edges.
    """
    if agg not in ("min", "max", "sum", "median", "collect"):
        raise ValueError(f"unknown focal aggregate {agg!r}")
    base, names = df.columns, list(values)
    src = df.select("*", *[as_col(c).alias(f"_v_{n}") for n, c in values.items()])
    if agg in ("median", "collect"):
        src = with_halo(src, runs_reach(runs), keys, block, mirror, shape)
        src = _array_pass(src, names, agg, runs, keys, block, base + (["_n_rows", "_n_cols"] if mirror else []))
        return _owned(src, block, mirror).select(*base, *names)
    if mirror:
        raise ValueError("mirrored edges are for median and collect")
    carry = [c for c in base if c not in (*keys, "row", "col")]
    src = with_halo(src.withColumn("_real", F.lit(True)), runs_reach(runs), keys, block)
    src = _gather(src, {f"_v_{n}": agg for n in names}, run_offsets(runs), keys, block, carry)
    return _owned(src, block, mirror=False).select(*base, *[F.col(f"_v_{n}").alias(n) for n in names])


def runs_reach(runs) -> int:
    return max(max(abs(d), abs(a), abs(b)) for d, (a, b) in runs.items())


def _array_pass(src: DataFrame, names, agg: str, runs, keys, block: int, keep) -> DataFrame:
    """Neighbour values as arrays: the row pass collects each distinct run, the column pass looks runs up."""
    reach, spans = runs_reach(runs), sorted(set(runs.values()))
    lo, hi = min(a for a, _ in runs.values()), max(b for _, b in runs.values())
    src, keep = _fill_rows(src, [f"_v_{n}" for n in names], lo, hi, keys, block), [*keep, _BR, _BC, "_real"]
    first, second = [], []
    for n in names:
        for i, (a, b) in enumerate(spans):
            across, _ = _windows(keys, a, b, 0, 0)
            first.append(F.collect_list(f"_v_{n}").over(across).alias(f"_a_{n}_{i}"))
        for d, span in sorted(runs.items()):
            _, down = _windows(keys, 0, 0, d, d)
            second.append(F.first(f"_a_{n}_{spans.index(span)}").over(down).alias(f"_b_{n}_{d + reach}"))
    src = src.select(*keep, *first).select(*keep, *second)
    empty = F.expr("cast(array() as array<double>)")
    out = []
    for n in names:
        near = F.concat(*[F.coalesce(F.col(f"_b_{n}_{d + reach}"), empty) for d in sorted(runs)])
        out.append((median_of(near) if agg == "median" else near).alias(n))
    return src.select(*keep, *out)


def median_of(values: Column) -> Column:
    s = F.sort_array(values)
    n = F.size(s)
    middle = (F.element_at(s, F.floor((n + 1) / 2).cast("int"))
              + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / F.lit(2.0)
    return F.when(n > 0, middle)


def erode_diamond(df: DataFrame, value: str, keys=("tile_id",), radius: int = 2, name: str = "eroded") -> DataFrame:
    """Minimum over the diamond; positions outside the image do not constrain."""
    return focal_runs(df, {name: value}, "min", diamond_runs(radius), keys)


def median_denoise(df: DataFrame, value: str, size: int = 3, keys=("tile_id",), shape=None,
                   name: str = "denoised") -> DataFrame:
    """Median of the size x size window with mirrored edges."""
    return focal_runs(df, {name: value}, "median", square_runs(size // 2), keys, mirror=True, shape=shape)


def opened(df: DataFrame, value: str, erode: float, dilate: float, iterations: int = 3,
           keys=("tile_id",), name: str = "opened", block: int = BLOCK) -> DataFrame:
    """Repeated circular minimum, then repeated circular maximum.

    The border covers the reach of all passes together, so the whole sequence
    runs inside the blocks after one shuffle.
    """
    base = df.columns
    carry = [c for c in base if c not in (*keys, "row", "col")]
    passes = [("min", circle_runs(erode))] * iterations + [("max", circle_runs(dilate))] * iterations
    reach = sum(runs_reach(r) for _, r in passes)
    src = with_halo(df.select("*", F.col(value).alias("_v"), F.lit(True).alias("_real")), reach, keys, block)
    for fold, runs in passes:
        src = _gather(src, {"_v": fold}, run_offsets(runs), keys, block, carry, margin=reach).filter("_real")
    return _owned(src, block, mirror=False).select(*base, F.col("_v").alias(name))
