"""Change detection: block PCA, neighbourhood projection, k-means, erosion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType, StructField, StructType

from swathframe.functions.common import floor_div
from swathframe.operators.focal import erode_diamond, focal_runs
from swathframe.operators.layout import attach
from swathframe.session import write_once

#: Pairs whose sums a task holds before it hands them on.
_HELD = 2000


def absolute_difference(df: DataFrame, pairs: dict, keys=("tile_id", "row", "col")) -> DataFrame:
    """``pairs`` maps a channel name to its (before, after) columns."""
    return df.select(*keys, *[F.abs(F.col(a) - F.col(b)).alias(n) for n, (a, b) in pairs.items()])


def block_vectors(diff: DataFrame, channels, k: int = 4, centre: str = "tile", keys=("tile_id",)) -> DataFrame:
    """Non-overlapping k x k blocks as vectors (channel-major), minus the mean vector.

    ``keys`` name an image.  The mean is taken per position inside the block, before anything is
    collected: ``centre`` is ``tile``, ``all`` or ``none``.
    """
    positioned = diff.withColumn("block_row", floor_div("row", k)).withColumn("block_col", floor_div("col", k)).withColumn(
        "_pos", ((F.col("row") % k) * k + F.col("col") % k).cast("int"))
    if centre != "none":
        group = [*keys, "_pos"] if centre == "tile" else ["_pos"]
        means = positioned.groupBy(*group).agg(*[F.avg(c).alias(f"_m_{c}") for c in channels])
        positioned = attach(positioned, means, group).withColumns({c: F.col(c) - F.col(f"_m_{c}") for c in channels})
    cells = F.array_sort(F.collect_list(F.struct("_pos", *channels)))
    blocks = positioned.groupBy(*keys, "block_row", "block_col").agg(cells.alias("_cells")).filter(
        F.size("_cells") == k * k)
    # A field of an array of structs is the array of that field.
    return blocks.select(*keys, "block_row", "block_col", F.concat(*[
        F.col(f"_cells.{c}") for c in channels]).alias("vector"))


def neighbourhoods(diff: DataFrame, channels, k: int = 4, shape=None, keys=("tile_id",)) -> DataFrame:
    """The k x k surroundings of every pixel as a vector, edges mirrored.

    Even k reaches k/2 before and k/2 - 1 after the pixel.
    """
    before, after = k // 2, (k - 1) // 2
    runs = {d: (-before, after) for d in range(-before, after + 1)}
    out = focal_runs(diff, {f"_n_{c}": F.col(c) for c in channels}, "collect", runs, keys, mirror=True, shape=shape)
    return out.select(*keys, "row", "col", F.concat(*[F.col(f"_n_{c}") for c in channels]).alias("vector")).filter(
        F.size("vector") == k * k * len(list(channels)))


def _features(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector("vector"))


def fit_change_model(diff: DataFrame, channels, k: int = 4, n_components: int = 3, clusters: int = 2,
                     seed: int = 1, batch: bool = False, shape=None) -> PipelineModel:
    """Centre, project and cluster: a saveable model of three stages.

    Fitted on one image pair, the projection subtracts the mean block; with
    ``batch`` the blocks are centred tile by tile first.
    """
    blocks = _features(block_vectors(diff, channels, k, "tile" if batch else "none"))
    scaler = StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False).fit(blocks)
    pca = PCA(k=n_components, inputCol="centred", outputCol="projected").fit(scaler.transform(blocks))
    around = _features(neighbourhoods(diff, channels, k, shape))
    projected = pca.transform(scaler.transform(around)).select("projected").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kmeans = KMeans(k=clusters, seed=seed, featuresCol="projected", predictionCol="cluster").fit(projected)
    finally:
        projected.unpersist()
    return PipelineModel([scaler, pca, kmeans])


def save_change_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_change_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def change_clusters(diff: DataFrame, channels, model: PipelineModel, k: int = 4, shape=None) -> DataFrame:
    return model.transform(_features(neighbourhoods(diff, channels, k, shape))).select(
        "tile_id", "row", "col", "cluster")


def change_map(clusters: DataFrame) -> DataFrame:
    """The least populated cluster is 255 in ``change``; ``clean`` is its 5x5 diamond erosion."""
    counts = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    rare = counts.agg(F.min_by("cluster", F.struct("n", "cluster")).alias("c")).scalar()
    mapped = clusters.select("tile_id", "row", "col", F.when(F.col("cluster") == rare, F.lit(255)).otherwise(
        F.lit(0)).alias("change"))
    return erode_diamond(mapped, "change", name="clean")


# --- one model for each image pair ----------------------------------------------------------------------------------

def _merged(a, b):
    """Count, mean and sum of outer products around the mean of two sets together."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _packed(fields, held) -> pa.RecordBatch:
    keys = [pa.array([key[i] for key in held], f.type) for i, f in enumerate(fields)]
    return pa.record_batch([*keys, pa.array([v[0] for v in held.values()], pa.int64()),
                            pa.array([np.concatenate([v[1], v[2].ravel()]).tobytes() for v in held.values()], pa.binary())],
                           names=[*(f.name for f in fields), "n", "moments"])


def _partial_moments(batches, width: int):
    """Rows (pair, vector) to one row for each pair that the task holds."""
    held, fields = {}, None
    for batch in batches:
        fields = [batch.schema.field(i) for i in range(width)]
        vectors = batch.column(width).flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else None
        rows = {}
        for at, key in enumerate(zip(*(batch.column(i).to_pylist() for i in range(width)))):
            rows.setdefault(key, []).append(at)
        for key, at in rows.items():
            own = vectors[at]
            mean = own.mean(axis=0)
            own = own - mean
            new = (len(at), mean, own.T @ own)
            held[key] = _merged(held[key], new) if key in held else new
        if len(held) > _HELD:
            yield _packed(fields, held)
            held = {}
    if held:
        yield _packed(fields, held)


def _principal(n: int, mean: np.ndarray, outer: np.ndarray, n_components: int):
    """(trace, variances, mean, components, offsets); a component's largest entry is positive."""
    cov = outer / max(n - 1, 1)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:n_components]
    components = vectors[:, order].T
    largest = np.abs(components).argmax(axis=1)
    components = components * np.where(components[np.arange(len(order)), largest] < 0, -1.0, 1.0)[:, None]
    return float(np.trace(cov)), np.maximum(values[order], 0.0).tolist(), mean.tolist(), components.tolist(), (components @ mean).tolist()


def _pair_models(batches, width: int, n_components: int):
    """Sums of one pair come one after the other and are added up as they come."""
    key, held, fields, done = None, None, None, []

    def flush():
        columns = list(zip(*((*k, *model) for k, model in done)))
        types = [*(f.type for f in fields), pa.int64(), pa.float64(), *[pa.list_(pa.float64())] * 2, pa.list_(pa.list_(pa.float64())),
                 pa.list_(pa.float64())]
        names = [*(f.name for f in fields), "n_blocks", "trace", "variances", "mean", "components", "offsets"]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    for batch in batches:
        fields = [batch.schema.field(i) for i in range(width)]
        for *own, n, moments in zip(*(c.to_pylist() for c in batch.columns)):
            values = np.frombuffer(moments)
            d = int(round((np.sqrt(4 * len(values) + 1) - 1) / 2))  # d + d * d numbers
            new = (n, values[:d], values[d:].reshape(d, d))
            if tuple(own) == key:
                held = _merged(held, new)
                continue
            if held is not None:
                done.append((key, (held[0], *_principal(*held, n_components))))
            key, held = tuple(own), new
        if len(done) > _HELD:
            yield flush()
            done = []
    if held is not None:
        done.append((key, (held[0], *_principal(*held, n_components))))
        yield flush()


def fit_pair_models(diff: DataFrame, channels, k: int = 4, n_components: int = 3, pair=("tile_id",), tile="tile_id") -> DataFrame:
    """A model for every image pair: its block mean and principal components.

    ``pair`` names the columns of a pair, which may hold several tiles.  Tasks
    send one sum for each pair they hold, whatever its size; the small
    eigenproblems are solved where the sums of a pair meet.  Columns: pair,
    n_blocks, trace (of the covariance), variances, mean, components, offsets
    (the projected mean).  A pair with one block has variances 0.
    """
    pair = list(pair)
    keys = list(dict.fromkeys([*pair, tile]))
    blocks = block_vectors(diff, channels, k, "none", keys).select(*pair, "vector")
    blocks = blocks.filter(F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v)))
    fields = [blocks.schema[p] for p in pair]
    numbers = ArrayType(DoubleType())
    sums = blocks.mapInArrow(lambda b: _partial_moments(b, len(pair)), StructType(
        [*fields, StructField("n", LongType()), StructField("moments", BinaryType())]))
    return sums.repartition(*pair).sortWithinPartitions(*pair).mapInArrow(
        lambda b: _pair_models(b, len(pair), n_components), StructType([
            *fields, StructField("n_blocks", LongType()), StructField("trace", DoubleType()), StructField("variances", numbers),
            StructField("mean", numbers), StructField("components", ArrayType(numbers)), StructField("offsets", numbers)]))


def project_pairs(diff: DataFrame, channels, models: DataFrame, k: int = 4, pair=("tile_id",), tile="tile_id", shape=None) -> DataFrame:
    """Every pixel's surroundings on the components of its own pair, as array ``p``."""
    keys = list(dict.fromkeys([*pair, tile]))
    around = attach(neighbourhoods(diff, channels, k, shape, keys), models.select(*pair, "components", "offsets"), list(pair))
    dot = lambda c: F.aggregate(F.zip_with("vector", c, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return around.select(*keys, "row", "col", F.zip_with(F.transform("components", dot), "offsets", lambda a, b: a - b).alias("p"))


def _nearest(point: str, centres: str) -> Column:
    """Number of the nearest centre; the first among equals."""
    def far(c, i):
        squares = F.zip_with(point, c, lambda a, b: (a - b) * (a - b))
        return F.struct(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b).alias("d"), i.alias("i"))
    return F.array_min(F.transform(centres, far))["i"]


def cluster_pairs(points: DataFrame, clusters: int = 2, rounds: int = 20, pair=("tile_id",)) -> DataFrame:
    """``points`` with their ``cluster``: k-means within every pair, all pairs in one job a round.

    Centres start evenly spread along the first component, so the result does
    not depend on chance.  A round joins the pairs' centres to the points and
    averages by pair and cluster; a cluster without points stays where it is.
    Ends after ``rounds`` or when no centre of any pair moves.  ``points`` has
    an array ``p`` and is read once a round: give a stored table.
    """
    pair = list(pair)
    first = F.col("p")[0]
    size = F.max(F.size("p")).alias("s")
    along = points.groupBy(*pair).agg(F.min(first).alias("lo"), F.max(first).alias("hi"), size)
    centres = write_once(along.select(*pair, F.transform(F.sequence(F.lit(0), F.lit(clusters - 1)), lambda i: F.concat(
        F.array(F.col("lo") + (i + 0.5) / clusters * (F.col("hi") - F.col("lo"))),
        F.array_repeat(F.lit(0.0), F.col("s") - 1))).alias("centres")))
    components = points.select(F.max(F.size("p"))).first()[0] or 0
    for _ in range(rounds):
        seated = attach(points, centres, pair).withColumn("cluster", _nearest("p", "centres"))
        means = seated.groupBy(*pair, "cluster").agg(F.array(*[F.avg(F.col("p")[j]) for j in range(components)]).alias("centre"))
        table = means.groupBy(*pair).agg(F.map_from_entries(F.collect_list(F.struct("cluster", "centre"))).alias("moved"))  # a row a cluster
        moved = centres.join(table, pair).select(*pair, F.col("centres").alias("old"), F.transform(
            "centres", lambda c, i: F.coalesce(F.try_element_at("moved", i), c)).alias("centres"))
        moved = write_once(moved)
        centres = moved.drop("old")
        if moved.filter("old <> centres").isEmpty():
            break
    return attach(points, centres, pair).withColumn("cluster", _nearest("p", "centres")).drop("centres", "p")


def pair_change_map(clusters: DataFrame, pair=("tile_id",), tile="tile_id") -> DataFrame:
    """``change`` is 255 in the least populated cluster of a pixel's own pair; ``clean`` is its 5x5 diamond erosion."""
    pair, keys = list(pair), list(dict.fromkeys([*pair, tile]))
    counts = clusters.groupBy(*pair, "cluster").agg(F.count(F.lit(1)).alias("n"))
    rare = counts.groupBy(*pair).agg(F.min_by("cluster", F.struct("n", "cluster")).alias("_rare"))
    mapped = attach(clusters, rare, pair).select(*keys, "row", "col", F.when(F.col("cluster") == F.col("_rare"), F.lit(255)).otherwise(
        F.lit(0)).alias("change"))
    return erode_diamond(mapped, "change", keys=keys, name="clean")


def detect_pair_changes(diff: DataFrame, channels, k: int = 4, n_components: int = 3, clusters: int = 2, rounds: int = 20,
                        pair=("tile_id",), tile="tile_id", shape=None) -> DataFrame:
    """Change map of every image pair by its own model: fit, project, cluster, rarest cluster, erosion."""
    models = write_once(fit_pair_models(diff, channels, k, n_components, pair, tile))
    points = write_once(project_pairs(diff, channels, models, k, pair, tile, shape))
    return pair_change_map(write_once(cluster_pairs(points, clusters, rounds, pair)), pair, tile)


def change_summary(maps: DataFrame, columns, keys=("tile_id",)) -> DataFrame:
    """Changed share per tile of each 0/255 map."""
    return maps.groupBy(*keys).agg(*[F.avg(F.col(c) / F.lit(255.0)).alias(f"{c}_share") for c in columns])


def kmeans_values(df: DataFrame, value: str, clusters: int, seed: int = 1, name: str = "cluster") -> DataFrame:
    """k-means on single values."""
    vectors = VectorAssembler(inputCols=[value], outputCol="_features", handleInvalid="skip").transform(df)
    model = KMeans(k=clusters, seed=seed, featuresCol="_features", predictionCol=name).fit(vectors)
    return model.transform(vectors).drop("_features")
