"""Change detection."""

from pyspark.sql import functions as F

from queries.fixtures import SQL_PIXELS, pixels, rd, rounded
from queries.focal import mirrored
from queries.indices import KEYS
from queries.registry import query
from swathframe.operators import change as ch
from swathframe.session import write_once

PAIRS = {"r": ("r_t0", "r_t1"), "nir": ("nir_t0", "nir_t1")}
SQL_DIFF = f'{SQL_PIXELS}, diff AS (SELECT tile_id, "row", col, abs(r_t0-r_t1) AS r, abs(nir_t0-nir_t1) AS nir FROM pixels)'


def difference(spark, sf):
    return ch.absolute_difference(pixels(spark, sf), PAIRS)


def _spread(vector):
    """Two position-dependent sums identify a vector without listing it."""
    weigh = lambda x, i: x * (i + 1)
    fold = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    return fold(vector), fold(F.transform(vector, weigh))


@query("absolute_difference", f'WITH {SQL_DIFF} SELECT tile_id, "row", col, {rd("r")} AS r, {rd("nir")} AS nir FROM diff')
def absolute_difference(spark, sf):
    return difference(spark, sf).select(*KEYS, rounded("r").alias("r"), rounded("nir").alias("nir"))


@query("block_vectors", f"""WITH {SQL_DIFF}, l AS (SELECT tile_id, "row"//4 AS br, col//4 AS bc, ("row"%4)*4+col%4 AS pos, r AS v, 0 AS ch FROM diff UNION ALL
    SELECT tile_id, "row"//4, col//4, ("row"%4)*4+col%4, nir, 1 FROM diff), c AS (SELECT *, v-AVG(v) OVER (PARTITION BY tile_id, pos, ch) AS x FROM l)
  SELECT tile_id, CAST(br AS INT) AS block_row, CAST(bc AS INT) AS block_col, {rd('SUM(x)', 5)} AS plain, {rd('SUM(x*(ch*16+pos+1))', 5)} AS weighted, CAST(COUNT(*) AS INT) AS n FROM c GROUP BY tile_id, br, bc""")
def block_vectors(spark, sf):
    out = ch.block_vectors(difference(spark, sf), ["r", "nir"])
    plain, weighted = _spread(F.col("vector"))
    return out.select("tile_id", "block_row", "block_col", rounded(plain, 5).alias("plain"), rounded(weighted, 5).alias("weighted"), F.size("vector").alias("n"))


@query("neighbourhoods", f"""WITH {SQL_DIFF}, o AS (SELECT a.tile_id, a."row" AS rw, a.col AS cl, (i.i+2)*4+j.j+2 AS pos, {mirrored('a."row"+i.i', 8)} AS r2, {mirrored('a.col+j.j', 8)} AS c2
    FROM diff a, range(-2, 2) i(i), range(-2, 2) j(j)), v AS (SELECT o.*, d.r, d.nir FROM o JOIN diff d ON d.tile_id = o.tile_id AND d."row" = r2 AND d.col = c2)
  SELECT tile_id, rw AS "row", cl AS col, {rd('SUM(r)+SUM(nir)', 5)} AS plain, {rd('SUM(r*(pos+1))+SUM(nir*(16+pos+1))', 5)} AS weighted, CAST(COUNT(*)*2 AS INT) AS n FROM v GROUP BY tile_id, rw, cl""")
def neighbourhoods(spark, sf):
    out = ch.neighbourhoods(difference(spark, sf), ["r", "nir"])
    plain, weighted = _spread(F.col("vector"))
    return out.select(*KEYS, rounded(plain, 5).alias("plain"), rounded(weighted, 5).alias("weighted"), F.size("vector").alias("n"))


@query("change_summary", f"WITH {SQL_DIFF} SELECT tile_id, {rd('AVG(CASE WHEN r > 0.1e0 THEN 1e0 ELSE 0e0 END)')} AS r_share, {rd('AVG(CASE WHEN nir > 0.1e0 THEN 1e0 ELSE 0e0 END)')} AS nir_share FROM diff GROUP BY tile_id")
def change_summary(spark, sf):
    maps = difference(spark, sf).select("tile_id", *[F.when(F.col(c) > 0.1, 255).otherwise(0).alias(c) for c in PAIRS])
    out = ch.change_summary(maps, list(PAIRS))
    return out.select("tile_id", *[rounded(c).alias(c) for c in ("r_share", "nir_share")])


@query("change_map")
def change_map(spark, sf):
    """All tiles as one pair of images: block PCA, projected neighbourhoods, two clusters, the rarer is change."""
    diff = difference(spark, sf)
    model = ch.fit_change_model(diff, list(PAIRS), k=4, n_components=3)
    return ch.change_map(ch.change_clusters(diff, list(PAIRS), model))


@query("batch_change_map")
def batch_change_map(spark, sf):
    """All tiles of one band, blocks centred tile by tile."""
    diff = difference(spark, sf).select(*KEYS, "r")
    model = ch.fit_change_model(diff, ["r"], k=4, n_components=3, batch=True)
    return ch.change_map(ch.change_clusters(diff, ["r"], model))


@query("kmeans_values")
def kmeans_values(spark, sf):
    out = ch.kmeans_values(pixels(spark, sf).select(*KEYS, "r_t0"), "r_t0", 3)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("r_t0").alias("lo"), F.max("r_t0").alias("hi"))


ROUNDS = 12


def paired(spark, sf):
    """Several tiles belong to one pair of images."""
    return difference(spark, sf).withColumn("pair_id", F.col("tile_id") % 9)


def _pair_sql() -> str:
    """Single pixels of two channels as blocks: principal axes in closed form, then one step of the statement a round."""
    steps = ["c0 AS (SELECT pair_id, i, lo + (i + 0.5e0) / 2 * (hi - lo) AS x, 0e0 AS y FROM (SELECT pair_id, MIN(p1) AS lo, MAX(p1) AS hi FROM p GROUP BY pair_id), range(2) t(i))"]
    seat = "a{k} AS MATERIALIZED (SELECT pair_id, tile_id, rw, cl, p1, p2, arg_min(i, ((p1-x)*(p1-x)+(p2-y)*(p2-y), i)) AS cluster FROM p JOIN c{k} USING (pair_id) GROUP BY ALL)"
    move = "c{n} AS MATERIALIZED (SELECT o.pair_id, o.i, coalesce(m.x, o.x) AS x, coalesce(m.y, o.y) AS y FROM c{k} o LEFT JOIN (SELECT pair_id, cluster AS i, AVG(p1) AS x, AVG(p2) AS y FROM a{k} GROUP BY ALL) m USING (pair_id, i))"
    for k in range(ROUNDS):
        steps += [seat.format(k=k), move.format(k=k, n=k + 1)]
    steps.append(seat.format(k=ROUNDS))
    return f"""WITH {SQL_DIFF}, d AS (SELECT *, tile_id % 9 AS pair_id FROM diff),
      m AS (SELECT pair_id, COUNT(*) AS n, AVG(r) AS mr, AVG(nir) AS mn, var_samp(r) AS a, var_samp(nir) AS c, covar_samp(r, nir) AS b FROM d GROUP BY pair_id),
      e AS (SELECT *, (a+c)/2 + sqrt(power((a-c)/2, 2) + b*b) AS l1, (a+c)/2 - sqrt(power((a-c)/2, 2) + b*b) AS l2 FROM m),
      v AS (SELECT *, b / sqrt(b*b + (l1-a)*(l1-a)) AS ux, (l1-a) / sqrt(b*b + (l1-a)*(l1-a)) AS uy FROM e),
      w AS (SELECT *, CASE WHEN abs(ux) >= abs(uy) THEN sign(ux) ELSE sign(uy) END AS s1, CASE WHEN abs(uy) >= abs(ux) THEN sign(-uy) ELSE sign(ux) END AS s2 FROM v),
      p AS MATERIALIZED (SELECT pair_id, tile_id, "row" AS rw, col AS cl, s1*(ux*(r-mr)+uy*(nir-mn)) AS p1, s2*(-uy*(r-mr)+ux*(nir-mn)) AS p2 FROM d JOIN w USING (pair_id)),
      {", ".join(steps)},
      sizes AS (SELECT pair_id, cluster, COUNT(*) AS n FROM a{ROUNDS} GROUP BY ALL),
      rare AS (SELECT pair_id, arg_min(cluster, (n, cluster)) AS cluster, MIN(n) AS n FROM sizes GROUP BY pair_id)"""


def _pair_models(spark, sf):
    diff = paired(spark, sf)
    return diff, write_once(ch.fit_pair_models(diff, list(PAIRS), 1, 2, pair=("pair_id",)))


@query("pair_models", f"{_pair_sql()} SELECT w.pair_id, w.n AS n_blocks, {rd('a+c')} AS trace, {rd('l1/(a+c)')} AS explained, rare.n AS n_change FROM w JOIN rare USING (pair_id)")
def pair_models(spark, sf):
    """Covariance trace, share of the first component, and size of the rarer cluster of every pair."""
    diff, models = _pair_models(spark, sf)
    points = write_once(ch.project_pairs(diff, list(PAIRS), models, 1, ("pair_id",)))
    sizes = ch.cluster_pairs(points, 2, ROUNDS, ("pair_id",)).groupBy("pair_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return models.join(sizes.groupBy("pair_id").agg(F.min("n").alias("n_change")), "pair_id").select(
        "pair_id", "n_blocks", rounded("trace").alias("trace"), rounded(F.col("variances")[0] / F.col("trace")).alias("explained"), "n_change")


@query("pair_change_map", f"""{_pair_sql()}, g AS (SELECT tile_id, rw, cl, CASE WHEN a{ROUNDS}.cluster = rare.cluster THEN 255 ELSE 0 END AS change FROM a{ROUNDS} JOIN rare USING (pair_id))
  SELECT a.tile_id % 9 AS pair_id, a.tile_id, a.rw AS "row", a.cl AS col, ANY_VALUE(a.change) AS change, MIN(b.change) AS clean FROM g a JOIN g b ON a.tile_id = b.tile_id AND abs(a.rw-b.rw)+abs(a.cl-b.cl) <= 2
  GROUP BY a.tile_id, a.rw, a.cl""")
def pair_change_map(spark, sf):
    """Every pair by its own model: principal axes, clusters, the pair's rarer cluster, erosion."""
    return ch.detect_pair_changes(paired(spark, sf), list(PAIRS), 1, 2, 2, ROUNDS, ("pair_id",))


@query("pair_block_variance", f"""WITH {SQL_DIFF}, l AS (SELECT tile_id % 9 AS pair_id, tile_id, "row"//4 AS br, col//4 AS bc, ("row"%4)*4+col%4 AS pos, unnest([r, nir]) AS v, unnest([0, 1]) AS ch FROM diff),
    s AS (SELECT pair_id, pos, ch, COUNT(*) AS n, var_samp(v) AS v FROM l GROUP BY ALL) SELECT pair_id, MIN(n) AS n_blocks, {rd('SUM(v)')} AS trace, {rd('SUM(v)')} AS explained FROM s GROUP BY pair_id""")
def pair_block_variance(spark, sf):
    """Blocks of 4 x 4 pixels and two channels: all 32 variances together are the trace."""
    models = ch.fit_pair_models(paired(spark, sf), list(PAIRS), 4, 32, pair=("pair_id",))
    return models.select("pair_id", "n_blocks", rounded("trace").alias("trace"),
                         rounded(F.aggregate("variances", F.lit(0.0), lambda a, x: a + x)).alias("explained"))


@query("kmeans_separable", f"WITH {SQL_PIXELS} SELECT COUNT(*) AS n, {rd('MIN(r_t0+10*(tile_id%3))')} AS lo, {rd('MAX(r_t0+10*(tile_id%3))')} AS hi FROM pixels GROUP BY tile_id % 3")
def kmeans_separable(spark, sf):
    """Values in three groups far apart: the clusters are the groups."""
    spread = pixels(spark, sf).select(*KEYS, (F.col("r_t0") + 10 * (F.col("tile_id") % 3)).alias("v"))
    return ch.kmeans_values(spread, "v", 3).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.min("v")).alias("lo"), rounded(F.max("v")).alias("hi")).drop("cluster")
