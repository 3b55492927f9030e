"""Distances to centroids, Lloyd's k-means, and the library k-means."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions import vectors
from doclens.functions.arrays import let, literal_array
from doclens.operators.numbering import row_numbers
from doclens.session import MAX_LITERAL_VALUES


# Numbers a table of centroids may hold: it is on the driver and on every executor. 400 MB of doubles.
MAX_CENTROID_VALUES = 50_000_000


def checked(centroids: list[list[float]], limit: int = MAX_CENTROID_VALUES) -> list[list[float]]:
    """The centroids, if they are small enough to be sent out."""
    size = sum(len(c) for c in centroids)
    if size > limit:
        raise ValueError(f"{size} numbers in the centroids, at most {limit} are sent to every task")
    return centroids


def first_k(points: DataFrame, k: int, id_col: str = "doc_id", vec: str = "vec") -> list[list[float]]:
    """The vectors of the ``k`` smallest ids: starting centroids, k x d numbers on the driver.

    The ids are picked first, so the vectors of other rows are never computed. Of rows that share an
    id, all count.
    """
    ids = F.broadcast(points.select(id_col).orderBy(id_col).limit(k))  # k rows
    rows = points.join(ids.distinct(), id_col, "left_semi").select(
        id_col, vectors.as_double(F.col(vec)).alias("_vec")
    )
    return checked([list(row["_vec"]) for row in rows.orderBy(id_col).limit(k).collect()])


def distances_to(
    points: DataFrame,
    centroids: list[list[float]],
    distance="euclidean",
    vec: str = "vec",
    out: str = "distances",
) -> DataFrame:
    """Add the array of distances to every centroid, in centroid order.

    The centroids are a constant of the plan, so no row meets another row.
    """
    measure = vectors.distance_function(distance)
    table = literal_array(checked(centroids, MAX_LITERAL_VALUES), "array<array<double>>")
    found = let(
        vectors.as_double(F.col(vec)), lambda v: F.transform(table, lambda c: measure(v, c))
    )
    return points.withColumn(out, found)


def pair_distances(
    points: DataFrame, centroids: list[list[float]], distance="euclidean", id_col: str = "doc_id", vec: str = "vec"
) -> DataFrame:
    """(id, cluster, distance): one row per point and centroid."""
    return distances_to(points, centroids, distance, vec).select(
        id_col, F.posexplode("distances").alias("cluster", "distance")
    )


_CACHED = 1 << 15  # numbers of a part of a batch: 256 kB


def _nearest_rows(rows: np.ndarray, centers: np.ndarray, distance: str) -> np.ndarray:
    """Nearest centroid of each row of a matrix, the lowest number on ties.

    One pass of array arithmetic per centroid; equal centroids give equal distances to the last bit.
    Rows are taken some at a time, so memory does not follow the number of centroids.
    """
    result = np.empty(len(rows), np.int32)
    # a part stays in a core's cache while all centroids pass over it
    width = max(1, rows.shape[1]) if rows.ndim == 2 else 1
    step = max(1, min(4_000_000 // max(1, len(centers)), max(64, _CACHED // width)))
    for start in range(0, len(rows), step):
        part = rows[start : start + step]
        found = np.empty((len(centers), len(part)))
        if distance == "euclidean":
            for number, center in enumerate(centers):
                found[number] = ((part - center) ** 2).sum(axis=1)
        else:
            lengths = np.sqrt((part * part).sum(axis=1))
            for number, center in enumerate(centers):
                norms = lengths * np.sqrt((center * center).sum())
                products = (part * center).sum(axis=1)
                found[number] = 1.0 - np.divide(products, norms, out=np.zeros_like(products), where=norms > 0)
        result[start : start + step] = found.argmin(axis=0)
    return result


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that are not null, and their places."""
    valid = np.flatnonzero(np.asarray(column.is_valid()))
    if not len(valid):
        return np.zeros((0, 0)), valid
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(valid), -1), valid


# Sent to workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def nearest_udf(spark, centroids: list[list[float]], distance: str):
    """Nearest centroid of a batch of vectors; null for a null vector."""
    table = spark.sparkContext.broadcast(np.asarray(checked(centroids), dtype=np.float64))

    @F.arrow_udf("int")
    def nearest(column: pa.Array) -> pa.Array:
        rows, valid = _matrix(column)
        found = np.full(len(column), -1, np.int32)
        found[valid] = _nearest_rows(rows, table.value, distance)
        return pa.array(found, mask=found < 0)

    return nearest


def nearest_by_terms(spark, terms: list[str], idf: list[float], centroids: list[list[float]], digits: int = 9):
    """``array<string> -> int``: the centroid nearest to a row's tf-idf vector, the lowest number on ties.

    Term counts times ``idf``, scaled to length 1, by euclidean distance rounded to ``digits``. Only
    the terms that occur are touched: sparse rows against a dense table of centroids.
    """
    table = spark.sparkContext.broadcast(
        (pa.array(terms, pa.string()), np.asarray(idf), np.asarray(checked(centroids), dtype=np.float64))
    )

    @F.arrow_udf("int")
    def nearest(tokens: pa.Array) -> pa.Array:
        known, weight, centers = table.value
        n, size = len(tokens), max(1, len(known))
        found = pc.index_in(tokens.flatten(), value_set=known)
        row = np.repeat(np.arange(n), np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)))
        valid = np.asarray(found.is_valid())
        place = np.asarray(found.drop_null()).astype(np.int64)
        cells, times = np.unique(row[valid] * size + place, return_counts=True)
        row, place = cells // size, cells % size
        values = times * weight[place]
        values = values / np.sqrt(np.bincount(row, values**2, minlength=n))[row]
        own = np.bincount(row, values**2, minlength=n)
        gaps = np.empty((len(centers), n))
        for number, center in enumerate(centers):
            dots = np.bincount(row, values * center[place], minlength=n)
            gaps[number] = np.sqrt(np.maximum(0.0, own + (center**2).sum() - 2.0 * dots))
        return pa.array(np.round(gaps, digits).argmin(axis=0).astype(np.int32))

    return nearest


def nearest(spark, centroids: list[list[float]], distance, vec: Column) -> Column:
    """Number of the nearest centroid. Named distances run on whole Arrow batches, any other
    function as a column expression. Over a vector made from the ids of ``encode`` in the same
    plan pass the function: Spark cannot plan one Arrow function over the result of another."""
    if isinstance(distance, str):
        return nearest_udf(spark, centroids, distance)(vectors.as_double(vec))
    measure = vectors.distance_function(distance)
    table = literal_array(checked(centroids, MAX_LITERAL_VALUES), "array<array<double>>")
    found = let(
        vectors.as_double(vec),
        lambda v: vectors.argmin(F.transform(table, lambda c: measure(v, c))),
    )
    return F.when(vec.isNotNull(), found)


def assign_nearest(
    points: DataFrame, centroids: list[list[float]], distance="euclidean", vec: str = "vec", out: str = "cluster"
) -> DataFrame:
    """Add the nearest centroid of each row; rows stay where they are."""
    return points.withColumn(out, nearest(points.sparkSession, centroids, distance, F.col(vec)))


def cluster_means(assigned: DataFrame, vec: str = "vec", cluster: str = "cluster") -> DataFrame:
    """(cluster, n, centroid). Partial sums leave each task, so a large cluster is no hot group."""
    vector = array_to_vector(vectors.as_double(F.col(vec)))
    return assigned.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.mean(vector).alias("_mean")
    ).select(cluster, "n", vector_to_array(F.col("_mean")).alias("centroid"))


@dataclass
class LloydModel:
    """Centroids after the last round, and the centroids its assignment was made with."""

    centroids: list[list[float]]
    assigned_by: list[list[float]]
    rounds: int
    converged: bool
    distance: object

    def predict(self, points: DataFrame, vec: str = "vec", out: str = "cluster") -> DataFrame:
        """Nearest final centroid, for new data."""
        return assign_nearest(points, self.centroids, self.distance, vec, out)

    def assignments(self, points: DataFrame, vec: str = "vec", out: str = "cluster") -> DataFrame:
        """The assignment of the last round, for the fitted data."""
        return assign_nearest(points, self.assigned_by, self.distance, vec, out)


def kmeans_lloyd(
    points: DataFrame,
    k: int,
    max_iters: int = 1000,
    distance="euclidean",
    id_col: str = "doc_id",
    vec: str = "vec",
    initial: list[list[float]] | None = None,
) -> LloydModel:
    """K-means from the first ``k`` rows by id, until no row changes cluster.

    Every row starts in cluster 0, so a first round that leaves all rows there ends
    the run. A round is one job: each task assigns its rows and sums them in array arithmetic, see
    ``_round_sums``, and k rows reach the driver. Sums are exact, so they are the same bits for any
    number of tasks, and a round that moves no row gives back its own centroids: nothing need be stored
    per row or computed twice. An empty cluster keeps its centroid. Null vectors are in no cluster;
    infinite numbers and NaN are an error. Points that are not cached are for the length of the run, on
    disk where memory ends.
    """
    current = checked(initial or first_k(points, k, id_col, vec))
    rows = points.select(vectors.as_double(F.col(vec)).alias("_v")).filter(F.col("_v").isNotNull())
    if points.storageLevel != StorageLevel.NONE:
        return _rounds(rows, current, max_iters, distance)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _rounds(rows, current, max_iters, distance)
    finally:
        rows.unpersist()


# A sum is a number in base 2^40: three limbs, of which the lowest two are below 2^40 and the top one has the
# sign. Rows are cut into limbs of a common unit and added in whole numbers, so no order changes a bit.
_LIMB = 40
_ROWS = 1 << 20  # rows added before limbs are carried: 2^20 numbers of 2^40 fit a long
_TASKS = 64  # tasks whose sums are added in one step


def _limbs(points: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2^40 units as whole units and parts of 2^-40; what is less is cut off, as it would
    be whatever else is added."""
    scaled = points / unit
    whole = np.floor(scaled)
    return whole.astype(np.int64), np.floor((scaled - whole) * float(1 << _LIMB)).astype(np.int64)


def _carried(limbs: np.ndarray) -> np.ndarray:
    """Limbs (lowest first along the first axis) brought into range."""
    for low in (0, 1):
        limbs[low + 1] += limbs[low] >> _LIMB
        limbs[low] &= (1 << _LIMB) - 1
    return limbs


def _total(limbs: np.ndarray, unit: float) -> np.ndarray:
    """The sums as doubles, by the same steps from the same whole numbers."""
    high = limbs[2].astype(np.float64) * float(1 << _LIMB) + limbs[1].astype(np.float64)
    return (high + limbs[0].astype(np.float64) / float(1 << _LIMB)) * unit


def sum_unit(rows: DataFrame, vec: str = "_v") -> float:
    """The unit of exact sums over all vectors: a power of two, 2^-39 of the largest number at least."""
    top = rows.agg(F.max(F.array_max(F.transform(vec, F.abs))).alias("m")).first()["m"]
    if top is not None and not math.isfinite(top):
        raise ValueError("vectors hold infinite numbers or NaN")
    return math.ldexp(1.0, math.frexp(top)[1] - _LIMB + 1) if top else 1.0


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums (cluster, n, limbs) in order of cluster, added: one centroid is held."""
    now, n, total = None, 0, None

    def made() -> pa.RecordBatch:
        values = [pa.array([now]), pa.array([n]), pa.array([total.ravel().tolist()], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(values, ["cluster", "n", "limbs"])

    for batch in batches:
        for i, (cluster, count) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True)):
            limbs = np.asarray(batch.column(2)[i].values).reshape(3, -1)
            if cluster != now:
                if now is not None:
                    yield made()
                now, n, total = cluster, 0, np.zeros_like(limbs)
            n, total = n + count, _carried(total + limbs)
    if now is not None:
        yield made()


def _round_sums(rows: DataFrame, centroids: list[list[float]], distance, unit: float) -> list:
    """(cluster, n, limbs) of the rows nearest to each centroid.

    Sums are whole numbers in three limbs. Those of many tasks are first added some at a time, the square
    root of their number; a merge holds one sum of one cluster."""
    spark = rows.sparkSession
    named = isinstance(distance, str)
    if not named:
        rows = rows.select("_v", nearest(spark, centroids, distance, F.col("_v")).alias("_now"))
    table = spark.sparkContext.broadcast(np.asarray(centroids, dtype=np.float64))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = table.value
        totals, sizes = np.zeros((len(centers), 3, centers.shape[1]), np.int64), np.zeros(len(centers), np.int64)
        for batch in batches:
            points, _ = _matrix(batch.column(0))
            if not len(points):
                continue
            now = _nearest_rows(points, centers, distance) if named else np.asarray(batch.column(1))
            for start in range(0, len(points), _ROWS):
                part = slice(start, start + _ROWS)
                whole, below = _limbs(points[part], unit)
                # rows by cluster, each cluster added as one run: whole numbers, so any order gives the same
                order = np.argsort(now[part], kind="stable")
                starts = np.flatnonzero(np.diff(now[part][order], prepend=-1))
                runs = now[part][order[starts]]
                totals[runs, 1] += np.add.reduceat(whole[order], starts, axis=0)
                totals[runs, 0] += np.add.reduceat(below[order], starts, axis=0)
                totals = np.stack([_carried(t) for t in totals])
            sizes += np.bincount(now, minlength=len(centers))
        seen = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(sizes[seen]), pa.array([t.ravel() for t in totals[seen]], pa.list_(pa.int64()))],
            ["cluster", "n", "limbs"],
        )

    schema = "cluster bigint, n bigint, limbs array<bigint>"
    parts = rows.mapInArrow(partial, schema)
    tasks = rows.rdd.getNumPartitions()
    if tasks > _TASKS:
        parts = parts.withColumn("_branch", F.spark_partition_id() % math.isqrt(tasks))
        ordered = parts.repartition("cluster", "_branch").sortWithinPartitions("cluster", "_branch")
        parts = ordered.select("cluster", "n", "limbs").mapInArrow(_added, schema)
    # number by number, then one centroid to a group; limbs are below 2^40, so millions of tasks add up in a long
    numbers = parts.select("cluster", F.posexplode(F.concat("limbs", F.array("n"))).alias("pos", "x"))
    sums = numbers.groupBy("cluster", "pos").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("pos", "x")))["x"].alias("_sums"))
    size = F.size("_sums")
    found = whole.select("cluster", F.get("_sums", size - 1).alias("n"), F.slice("_sums", 1, size - 1).alias("limbs")).collect()
    table.destroy()
    return found


def _rounds(rows: DataFrame, current: list[list[float]], max_iters: int, distance) -> LloydModel:
    previous: list[list[float]] | None = None
    unit = sum_unit(rows)
    for rounds in range(1, max_iters + 1):
        means = [list(center) for center in current]
        found = _round_sums(rows, current, distance, unit)
        for row in found:
            total = _total(np.array(row["limbs"]).reshape(3, -1), unit)
            means[row["cluster"]] = (total / row["n"]).tolist()
        still = means == current or (rounds == 1 and all(row["cluster"] == 0 for row in found))
        previous, current = current, means
        if still:
            return LloydModel(current, previous, rounds, True, distance)
    return LloydModel(current, previous or current, max_iters, False, distance)


def kmeans_fit(
    vectors_df: DataFrame, k: int, features: str = "features", seed: int = 0, max_iter: int = 100
) -> KMeansModel:
    """Library k-means with parallel seeding."""
    return KMeans(
        k=k, featuresCol=features, predictionCol="cluster", initMode="k-means||", seed=seed, maxIter=max_iter
    ).fit(vectors_df)


def choose_k(train: DataFrame, k: int = 0, topics: str = "topics") -> int:
    """``k`` if given, else the number of distinct training labels."""
    return k or label_count(train, topics).first()["n_labels"]


def label_count(train: DataFrame, topics: str = "topics") -> DataFrame:
    return train.select(F.explode(topics).alias("label")).agg(
        F.countDistinct("label").alias("n_labels")
    )


def cluster_members(assigned: DataFrame, id_col: str = "doc_id", cluster: str = "cluster") -> DataFrame:
    """(cluster, member_no, id, size): members numbered by id. Rows, not lists: a cluster may hold
    most of the data."""
    sizes = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    numbered = row_numbers(
        assigned.select(cluster, id_col), [F.col(id_col)], [cluster], "member_no"
    )
    return numbered.join(F.broadcast(sizes), cluster)
