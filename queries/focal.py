"""Neighbourhood operators."""

from pyspark.sql import functions as F

from queries.fixtures import SQL_BANDS, SQL_PIXELS, bands13, pixels, rd, rounded
from queries.indices import KEYS
from queries.registry import query
from swathframe.operators import focal as fo
from swathframe.operators import speckle

SCENE = ["scene_id", "row", "col"]
SCENE_SQL = 'scene_id, "row", col'


def window_sql(select, condition, table="bands13"):
    """Neighbours ``b`` of each pixel ``a``."""
    return f'SELECT a.scene_id, a."row", a.col, {select} FROM {table} a JOIN {table} b ON a.scene_id = b.scene_id AND {condition} GROUP BY a.scene_id, a."row", a.col'


def square(r):
    return f'b."row" BETWEEN a."row"-{r} AND a."row"+{r} AND b.col BETWEEN a.col-{r} AND a.col+{r}'


def runs_condition(runs):
    return "(" + " OR ".join(f'(b."row" = a."row"+({d}) AND b.col BETWEEN a.col+({lo}) AND a.col+({hi}))' for d, (lo, hi) in runs.items()) + ")"


DISC3 = {-3: (0, 0), -2: (-2, 2), -1: (-2, 2), 0: (-3, 3), 1: (-2, 2), 2: (-2, 2), 3: (0, 0)}
DISC1 = {-1: (-1, 1), 0: (-1, 1), 1: (-1, 1)}
DIAMOND = {-2: (0, 0), -1: (-1, 1), 0: (-2, 2), 1: (-1, 1), 2: (0, 0)}


@query("focal_mean", f"WITH {SQL_BANDS} {window_sql(rd('AVG(b.b4)', 7) + ' AS b4, ' + rd('AVG(b.b11)', 7) + ' AS b11, COUNT(b.b4) AS n', square(2))}")
def focal_mean(spark, sf):
    out = fo.focal_square(bands13(spark, sf).select(*SCENE, "b4", "b11"), {"m4": F.col("b4"), "m11": F.col("b11")}, "mean", 2, ("scene_id",), counts=True)
    return out.select(*SCENE, rounded("m4", 7).alias("b4"), rounded("m11", 7).alias("b11"), F.col("m4_n").alias("n"))


@query("focal_mean_blocks", f"WITH {SQL_BANDS} {window_sql(rd('AVG(b.b4)', 7) + ' AS b4', square(5))}")
def focal_mean_blocks(spark, sf):
    """Small blocks: every scene is cut into sixteen independent pieces with a border."""
    out = fo.focal_square(bands13(spark, sf).select(*SCENE, "b4"), {"m4": F.col("b4")}, "mean", 5, ("scene_id",), block=8)
    return out.select(*SCENE, rounded("m4", 7).alias("b4"))


@query("focal_min_max_sum", f"WITH {SQL_BANDS} {window_sql(rd('MIN(b.b4)') + ' AS lo, ' + rd('MAX(b.b4)') + ' AS hi, ' + rd('SUM(b.b4)') + ' AS total', square(1))}")
def focal_min_max_sum(spark, sf):
    out = bands13(spark, sf).select(*SCENE, "b4")
    for name, agg in (("lo", "min"), ("hi", "max"), ("total", "sum")):
        out = fo.focal_square(out, {name: F.col("b4")}, agg, 1, ("scene_id",))
    return out.select(*SCENE, *[rounded(c).alias(c) for c in ("lo", "hi", "total")])


@query("focal_circle", f"WITH {SQL_BANDS} {window_sql(rd('MIN(b.b4)') + ' AS lo, ' + rd('MAX(b.b4)') + ' AS hi', runs_condition(DISC3))}")
def focal_circle(spark, sf):
    out = fo.focal_runs(bands13(spark, sf).select(*SCENE, "b4"), {"lo": F.col("b4")}, "min", fo.circle_runs(3.0), ("scene_id",))
    out = fo.focal_runs(out, {"hi": F.col("b4")}, "max", fo.circle_runs(3.0), ("scene_id",))
    return out.select(*SCENE, rounded("lo").alias("lo"), rounded("hi").alias("hi"))


@query("erode_diamond", f"WITH {SQL_BANDS} {window_sql(rd('MIN(b.b4)') + ' AS eroded', runs_condition(DIAMOND))}")
def erode_diamond(spark, sf):
    out = fo.erode_diamond(bands13(spark, sf).select(*SCENE, "b4"), "b4", ("scene_id",))
    return out.select(*SCENE, rounded("eroded").alias("eroded"))


def mirrored(pos, n):
    return f"(CASE WHEN {pos} < 0 THEN -1-({pos}) WHEN {pos} >= {n} THEN 2*{n}-1-({pos}) ELSE {pos} END)"


@query("median_denoise", f"""WITH {SQL_PIXELS}, o AS (SELECT a.tile_id, a."row" AS rw, a.col AS cl, {mirrored('a."row"+i.i', 8)} AS r2, {mirrored('a.col+j.j', 8)} AS c2
    FROM pixels a, range(-1, 2) i(i), range(-1, 2) j(j))
  SELECT o.tile_id, rw AS "row", cl AS col, {rd('median(p.r_t0)')} AS denoised FROM o JOIN pixels p ON p.tile_id = o.tile_id AND p."row" = r2 AND p.col = c2 GROUP BY o.tile_id, rw, cl""")
def median_denoise(spark, sf):
    out = fo.median_denoise(pixels(spark, sf).select(*KEYS, "r_t0"), "r_t0")
    return out.select(*KEYS, rounded("denoised").alias("denoised"))


def mmse_sql(z, m, v, noise):
    signal = f"greatest(({v}-{m}*{m}*{noise})/(1+{noise}), 0e0)"
    return f"{m}+least(COALESCE({signal}/NULLIF({v},0), 0e0), 1e0)*({z}-{m})"


@query("lee_filter", f"""WITH {SQL_BANDS}, z AS (SELECT scene_id, "row", col, sqrt(b8+0.01e0) AS z FROM bands13),
  w AS ({window_sql('MAX(a.z) AS z, AVG(b.z) AS m, AVG(b.z*b.z) AS m2', square(4), 'z')})
  SELECT {SCENE_SQL}, {rd(mmse_sql('z', 'm', '(m2-m*m)', '0.1e0'), 7)} AS filtered FROM w""")
def lee_filter(spark, sf):
    z = bands13(spark, sf).select(*SCENE, F.sqrt(F.col("b8") + 0.01).alias("z"))
    return speckle.lee_filter(z, "z", 9, looks=10.0, keys=("scene_id",)).select(*SCENE, rounded("filtered", 7).alias("filtered"))


@query("lee_sigma_filter", f"""WITH {SQL_BANDS}, z AS (SELECT scene_id, "row", col, sqrt(b8+0.01e0) AS z FROM bands13),
  w AS ({window_sql('MAX(a.z) AS z, AVG(b.z) AS m, AVG(b.z*b.z) AS m2', square(2), 'z')}),
  prior AS (SELECT scene_id, "row", col, z, {mmse_sql('z', 'm', '(m2-m*m)', '1e0')} AS p FROM w),
  s AS (SELECT a.scene_id, a."row", a.col, MAX(a.z) AS z, MAX(a.p) AS p, COUNT(b.z) AS n, AVG(b.z) AS m, AVG(b.z*b.z) AS m2 FROM prior a LEFT JOIN prior b
    ON a.scene_id = b.scene_id AND {square(4)} AND b.z >= 0.084e0*a.p AND b.z <= 3.941e0*a.p GROUP BY a.scene_id, a."row", a.col)
  SELECT {SCENE_SQL}, {rd(f"CASE WHEN n > 0 THEN {mmse_sql('z', 'm', '(m2-m*m)', '0.67092481e0')} ELSE p END", 7)} AS filtered FROM s""")
def lee_sigma_filter(spark, sf):
    z = bands13(spark, sf).select(*SCENE, F.sqrt(F.col("b8") + 0.01).alias("z"))
    return speckle.lee_sigma_filter(z, "z", keys=("scene_id",)).select(*SCENE, rounded("filtered", 7).alias("filtered"))


def opened_sql(table, value):
    """Three minima over the small disc, then three maxima over the large one, as chained CTEs."""
    out, last = [f'op0 AS (SELECT scene_id, "row", col, {value} AS v FROM {table})'], "op0"
    for i in range(1, 7):
        agg, runs = ("MIN", DISC1) if i <= 3 else ("MAX", DISC3)
        out.append(f"op{i} AS ({window_sql(f'{agg}(b.v) AS v', runs_condition(runs), last)})")
        last = f"op{i}"
    return ", ".join(out), last


_OPENED, _LAST = opened_sql("bands13", "b4")


@query("dilated_erosion", f"WITH {SQL_BANDS}, {_OPENED} SELECT {SCENE_SQL}, {rd('v')} AS opened FROM {_LAST}")
def dilated_erosion(spark, sf):
    from swathframe.operators.clouds import dilated_erosion as op
    return op(bands13(spark, sf).select(*SCENE, "b4"), "b4").select(*SCENE, rounded("opened").alias("opened"))


SIDES = [(0, 1), (-1, 1), (-1, 0), (-1, -1)]
PARTS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
SQL_UNEVEN = """z AS (SELECT scene_id, "row", col, sqrt(b8+0.01e0)+0.01e0*(("row"*37+col*101+scene_id*13)%997)/997 AS z FROM bands13)"""


def refined_lee_sql(noise):
    """Nine parts and eight halves of each window as filtered aggregates; the strongest change and its nearer side choose one."""
    def part(i, j):
        return f"p{i + 1}{j + 1}"

    def toward(r, c):
        return "(" + "+".join(part(i, j) for i, j in PARTS if i * r + j * c > 0) + ")"

    inside = {part(i, j): f'abs(b."row"-a."row"-({2 * i})) <= 1 AND abs(b.col-a.col-({2 * j})) <= 1' for i, j in PARTS}
    half = {f"{n}{k}": f'(b."row"-a."row")*({f * r})+(b.col-a.col)*({f * c}) >= 0'
            for k, (r, c) in enumerate(SIDES) for n, f in (("s", 1), ("t", -1))}
    found = ", ".join([f"AVG(b.z) FILTER ({c}) AS {n}, VAR_POP(b.z) FILTER ({c}) AS v{n}" for n, c in inside.items()]
                      + [f"AVG(b.z) FILTER ({c}) AS m{n}, VAR_POP(b.z) FILTER ({c}) AS v{n}" for n, c in half.items()])
    change = [f"abs({toward(r, c)}-{toward(-r, -c)})" for r, c in SIDES]
    strongest = f"greatest({', '.join(change)})"

    def chosen(x):
        sides = " ".join(f"WHEN {g} = {strongest} THEN CASE WHEN abs({part(r, c)}-p11) <= abs({part(-r, -c)}-p11) THEN {x}s{k} ELSE {x}t{k} END"
                         for k, (g, (r, c)) in enumerate(zip(change, SIDES)))
        return f"CASE WHEN n < 49 THEN {x} {sides} END"

    relative = ", ".join(f"v{part(i, j)}/({part(i, j)}*{part(i, j)})" for i, j in PARTS)
    measured = f"CASE WHEN n < 49 THEN v/(m*m) ELSE list_sum(list_slice(list_sort([{relative}]), 1, 5))/5 END"
    window = window_sql(f"MAX(a.z) AS z, COUNT(b.z) AS n, AVG(b.z) AS m, VAR_POP(b.z) AS v, {found}", square(3), "z")
    return f"""WITH {SQL_BANDS}, {SQL_UNEVEN}, w AS ({window}),
  c AS (SELECT {SCENE_SQL}, z, {chosen('m')} AS mean, {chosen('v')} AS var, {noise or measured} AS noise FROM w)
  SELECT {SCENE_SQL}, {rd(mmse_sql('z', 'mean', 'var', 'noise'), 7)} AS filtered FROM c"""


def uneven(spark, sf):
    step = (F.col("row") * 37 + F.col("col") * 101 + F.col("scene_id") * 13) % 997
    return bands13(spark, sf).select(*SCENE, (F.sqrt(F.col("b8") + 0.01) + F.lit(0.01) * step / 997).alias("z"))


@query("refined_lee_filter", refined_lee_sql("0.01e0"))
def refined_lee(spark, sf):
    return speckle.refined_lee_filter(uneven(spark, sf), "z", 100.0, ("scene_id",), block=20).select(*SCENE, rounded("filtered", 7).alias("filtered"))


@query("refined_lee_filter_measured", refined_lee_sql(None))
def refined_lee_measured(spark, sf):
    """The noise is measured in the parts of each window."""
    return speckle.refined_lee_filter(uneven(spark, sf), "z", None, ("scene_id",)).select(*SCENE, rounded("filtered", 7).alias("filtered"))
