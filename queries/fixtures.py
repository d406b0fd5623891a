"""Image and scene tables derived from the given tables, as Spark plans and as SQL.

Every fixture covers its whole source table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from swathframe.constants import LABEL_CHANNELS, X_CHANNELS

CHANNELS = X_CHANNELS + LABEL_CHANNELS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value, digits: int = 6) -> Column:
    """Rounded double without a negative zero, so engines agree on the last bit."""
    v = F.col(value) if isinstance(value, str) else value
    return F.round(v.cast("double"), digits) + F.lit(0.0)


def rd(expression: str, digits: int = 6) -> str:
    """The same in SQL."""
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0e0)"


# --- pixels: 8 x 8 tiles of twelve bands, from embeddings --------------------

def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    # The last tile takes its missing bands from the first vectors, so every vector is in some tile.
    n = emb.agg(F.count(F.lit(1)).alias("n")).scalar()
    wrapped = emb.filter(F.col("vec_id") < (12 - n % 12) % 12).withColumn("vec_id", F.col("vec_id") + n)
    emb = emb.unionByName(wrapped)
    k = F.col("vec_id") % 12
    per_tile = emb.groupBy(F.floor(F.col("vec_id") / 12).cast("long").alias("tile_id")).agg(
        F.max(F.when(k == 0, F.col("label"))).alias("_label"),
        *[F.max(F.when(k == i, F.col("embedding"))).alias(f"_e{i}") for i in range(12)])
    cells = per_tile.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(63))))

    def band(i):
        v = F.get(f"_e{i}", F.col("pos")).cast("double")
        return v if i < 4 else (v + 1) / F.lit(2.0)

    return cells.select(
        "tile_id", F.floor(F.col("pos") / 8).cast("int").alias("row"), (F.col("pos") % 8).cast("int").alias("col"),
        *[band(i).alias(c) for i, c in enumerate(CHANNELS)],
        ((F.col("_label") * 2 + F.floor(F.col("pos") / 16)) % 24).cast("int").alias("class_id"))


def _band_sql(i: int, name: str) -> str:
    v = "CAST(val AS DOUBLE)" if i < 4 else "(CAST(val AS DOUBLE)+1)/2"
    return f"MAX(CASE WHEN v % 12 = {i} THEN {v} END) AS {name}"


SQL_PIXELS = f"""pixels AS (
  SELECT CAST(v // 12 AS BIGINT) AS tile_id, CAST(pos // 8 AS INT) AS "row", CAST(pos % 8 AS INT) AS col,
         {', '.join(_band_sql(i, c) for i, c in enumerate(CHANNELS))},
         CAST(MAX(CASE WHEN v % 12 = 0 THEN (label * 2 + pos // 16) % 24 END) AS INT) AS class_id
  FROM (SELECT vec_id AS v, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS val
        FROM (SELECT vec_id, label, embedding FROM embeddings UNION ALL
              SELECT vec_id + (SELECT COUNT(*) FROM embeddings), label, embedding FROM embeddings
              WHERE vec_id < (12 - (SELECT COUNT(*) FROM embeddings) % 12) % 12)) e
  GROUP BY v // 12, pos)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels plus a predicted image: the label shifted by a small pattern."""
    shift = ((F.col("row") * 7 + F.col("col")) % 5 - 2) * F.lit(0.01)
    return pixels(spark, sf_dir).withColumns({f"{b}_pred": F.col(f"{b}_t1") + shift for b in ("r", "g", "b", "nir")})


SQL_PREDICTIONS = SQL_PIXELS + """, predictions AS (
  SELECT *, r_t1 + s AS r_pred, g_t1 + s AS g_pred, b_t1 + s AS b_pred, nir_t1 + s AS nir_pred
  FROM (SELECT *, (("row" * 7 + col) % 5 - 2) * 0.01e0 AS s FROM pixels))"""


# --- pix_flat: many pixels without position, from lineitem -------------------

def pix_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    d, t = F.col("l_discount"), F.col("l_tax")
    return li.select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") % 64).alias("tile_id"),
        (F.col("l_partkey") % 24).cast("int").alias("class_id"),
        (d * 5 + 0.05).alias("r_t0"), (t * 5 + 0.30).alias("nir_t0"), (F.col("l_quantity") / 100).alias("b_t0"),
        (d * 4 + 0.10).alias("r_t1"), (t * 3 + 0.20).alias("nir_t1"),
        (d * 4 + 0.09 + (F.col("l_suppkey") % 5) * 0.01).alias("r_pred"), (t * 3 + 0.20).alias("nir_pred"))


SQL_FLAT = """pix_flat AS (
  SELECT l_orderkey, l_linenumber, l_orderkey % 64 AS tile_id, CAST(l_partkey % 24 AS INT) AS class_id,
    l_discount*5e0+0.05e0 AS r_t0, l_tax*5e0+0.30e0 AS nir_t0, l_quantity/100e0 AS b_t0,
    l_discount*4e0+0.10e0 AS r_t1, l_tax*3e0+0.20e0 AS nir_t1,
    l_discount*4e0+0.09e0+(l_suppkey%5)*0.01e0 AS r_pred, l_tax*3e0+0.20e0 AS nir_pred
  FROM lineitem)"""


# --- bands13: 32 x 32 scenes of reflectances with gaps, from lineitem by order

# Long factors keep sums and means away from exact decimals, where engines round differently.
_BANDS13 = {"b1": ("t1", 2.98765432101, 0.0812345678912), "b2": ("d1", 3.01234567891, 0.0512345678912),
            "b3": ("d0", 3.01234567891, 0.0498765432109), "b4": ("q1", 0.00987654321012, 0.0),
            "b8": ("q1", 0.0123456789123, 0.0), "b10": ("t0", 0.987654321012, 0.0),
            "b11": ("q0", 0.0123456789321, 0.0201234567891), "b12": ("q0", 0.00987654321098, 0.0)}


def bands13(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    by_order = li.groupBy("l_orderkey").agg(
        F.max("l_discount").alias("d1"), F.min("l_discount").alias("d0"), F.max("l_tax").alias("t1"),
        F.min("l_tax").alias("t0"), F.max("l_quantity").alias("q1"), F.min("l_quantity").alias("q0"))
    pos = F.col("l_orderkey") % 1024
    return by_order.select(
        F.floor(F.col("l_orderkey") / 1024).cast("long").alias("scene_id"),
        F.floor(pos / 32).cast("int").alias("row"), (pos % 32).cast("int").alias("col"),
        *[(F.col(c) * scale + shift).alias(b) for b, (c, scale, shift) in _BANDS13.items()])


SQL_BANDS = f"""bands13 AS (
  SELECT CAST(l_orderkey // 1024 AS BIGINT) AS scene_id, CAST((l_orderkey % 1024) // 32 AS INT) AS "row",
    CAST(l_orderkey % 32 AS INT) AS col,
    {', '.join(f'{c}*{scale!r}::DOUBLE+{shift!r}::DOUBLE AS {b}' for b, (c, scale, shift) in _BANDS13.items())}
  FROM (SELECT l_orderkey, MAX(l_discount) d1, MIN(l_discount) d0, MAX(l_tax) t1, MIN(l_tax) t0,
               MAX(l_quantity) q1, MIN(l_quantity) q0 FROM lineitem GROUP BY l_orderkey))"""


# --- scenes: a catalogue of radar and optical acquisitions, from events ------

def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    eid, tile = F.col("event_id"), F.col("user_id") % 10
    number = {"view": "S2A", "click": "S2B", "purchase": "S1A", "signup": "S3A"}
    sat = F.lit("S5P")
    for kind, name in number.items():
        sat = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(sat)
    return ev.select(
        eid.alias("scene_id"), F.when(F.col("event_type").isin("view", "click"), 2).otherwise(1).alias("sensor"),
        sat.alias("sat_id"), F.col("ts").alias("acquired_at"), tile.alias("tile_no"), F.col("user_id").alias("orbit_no"),
        F.when(eid % 2 == 0, "DESCENDING").otherwise("ASCENDING").alias("pass_direction"),
        F.when(eid % 3 == 0, F.array(F.lit("VV"))).when(eid % 3 == 1, F.array(F.lit("VH"))).otherwise(
            F.array(F.lit("VV"), F.lit("VH"))).alias("polarisations"),
        F.when(eid % 5 == 0, "EW").when(eid % 7 == 0, "WV").otherwise("IW").alias("mode"),
        F.when(eid % 3 == 0, "GRD").when(eid % 3 == 1, "SLC").otherwise("OCN").alias("product_type"),
        (F.col("value") / 5).alias("cloud_pct"),
        (F.lit(149.0) + tile * 0.1).alias("xmin"), F.lit(-35.0).alias("ymin"),
        (F.lit(149.05) + tile * 0.1 + (eid % 7) * 0.01).alias("xmax"), F.lit(-34.9).alias("ymax"))


SQL_SCENES = """scenes AS (
  SELECT event_id AS scene_id, CASE WHEN event_type IN ('view','click') THEN 2 ELSE 1 END AS sensor,
    CASE event_type WHEN 'view' THEN 'S2A' WHEN 'click' THEN 'S2B' WHEN 'purchase' THEN 'S1A' WHEN 'signup' THEN 'S3A' ELSE 'S5P' END AS sat_id,
    ts AS acquired_at, user_id % 10 AS tile_no, user_id AS orbit_no,
    CASE WHEN event_id % 2 = 0 THEN 'DESCENDING' ELSE 'ASCENDING' END AS pass_direction,
    CASE WHEN event_id % 3 = 0 THEN ['VV'] WHEN event_id % 3 = 1 THEN ['VH'] ELSE ['VV','VH'] END AS polarisations,
    CASE WHEN event_id % 5 = 0 THEN 'EW' WHEN event_id % 7 = 0 THEN 'WV' ELSE 'IW' END AS mode,
    CASE WHEN event_id % 3 = 0 THEN 'GRD' WHEN event_id % 3 = 1 THEN 'SLC' ELSE 'OCN' END AS product_type,
    value / 5e0 AS cloud_pct, 149e0 + (user_id % 10) * 0.1e0 AS xmin, -35e0 AS ymin,
    149.05e0 + (user_id % 10) * 0.1e0 + (event_id % 7) * 0.01e0 AS xmax, -34.9e0 AS ymax
  FROM events)"""

# A zone over tiles 3 to 6 of the catalogue.
ZONE = (149.32, -34.98, 149.38, -34.92)
SQL_IN_ZONE = "xmin <= 149.38e0 AND xmax >= 149.32e0 AND ymin <= -34.92e0 AND ymax >= -34.98e0"


# --- mosaic scenes: overlapping images on one grid, from pixels --------------

def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles on a map: neighbours overlap by two columns, the tile number is the drawing order."""
    return pixels(spark, sf_dir).withColumn("x", ((F.col("tile_id") % 5) * 6 + F.col("col")).cast("int")).withColumn(
        "y", (F.col("row") + 8 * F.floor(F.col("tile_id") / 5)).cast("int")).withColumn("source_order", F.col("tile_id"))


SQL_PLACED = SQL_PIXELS + """, placed AS (
  SELECT *, CAST((tile_id % 5) * 6 + col AS INT) AS x, CAST("row" + 8 * (tile_id // 5) AS INT) AS y,
         tile_id AS source_order FROM pixels)"""
