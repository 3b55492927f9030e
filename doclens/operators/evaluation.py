"""Scores of a clustering against labels, and of two clusterings against each other."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions import sampling, vectors
from doclens.operators.clustering import MAX_CENTROID_VALUES
from doclens.operators.lookup import bounded_rows, unnest
from doclens.session import written

# Sent to workers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- one clustering against labels: rows hold ``cluster`` and ``topics`` ---


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def cluster_label_counts(assigned: DataFrame) -> DataFrame:
    """(cluster, label, n); a document counts once for each of its labels."""
    return (
        unnest(assigned, ["cluster"], F.col("topics"), "label")
        .groupBy("cluster", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_labels(counts: DataFrame, limit: int = 5) -> DataFrame:
    """The most frequent labels of each cluster, ties by label, with ``rank`` from 1."""
    order = Window.partitionBy("cluster").orderBy(F.col("n").desc(), F.col("label"))
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).filter(
        F.col("rank") <= limit
    )


def cluster_purities(assigned: DataFrame) -> DataFrame:
    """(cluster, size, label, n, purity): share of the most frequent label, 0 without labels."""
    top = top_labels(cluster_label_counts(assigned), 1).select("cluster", "label", "n")
    return cluster_sizes(assigned).join(top, "cluster", "left").select(
        "cluster",
        "size",
        "label",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(F.col("n") / F.col("size"), F.lit(0.0)).alias("purity"),
    )


def pseudo_purity(assigned: DataFrame) -> DataFrame:
    """Unweighted mean purity over the clusters that have members."""
    return cluster_purities(assigned).agg(F.avg("purity").alias("pseudo_purity"))


def top_label_hit_rate(test: DataFrame, top: DataFrame, limit: int = 5) -> DataFrame:
    """Mean share of a test document's labels found among the top labels of its cluster.

    A document's share is hits / min(limit, labels); one without labels adds 0 and still counts.
    The broadcast table has one row per cluster.
    """
    guesses = top.groupBy("cluster").agg(F.collect_set("label").alias("_guesses"))
    joined = test.select("cluster", "topics").join(F.broadcast(guesses), "cluster", "left")
    hits = F.size(F.filter("topics", lambda label: F.array_contains(F.col("_guesses"), label)))
    n_labels = F.size("topics")
    share = F.when(
        (n_labels > 0) & F.col("_guesses").isNotNull(), hits / F.least(F.lit(limit), n_labels)
    ).otherwise(0.0)
    return joined.agg((F.sum(share) / F.count(F.lit(1))).alias("hit_rate"))


# --- silhouette ---


def silhouette_sample(
    assigned: DataFrame, sample_size: int = 1000, seed: int = 0, id_col: str = "doc_id"
) -> DataFrame:
    """The rows with the smallest hashes; sampling is part of the score's definition."""
    digits = sampling.hash_hex(seed, F.col(id_col))
    return assigned.withColumn("_hex", digits).orderBy("_hex", id_col).limit(sample_size).drop("_hex")


def silhouettes(
    sample: DataFrame, vec: str = "vec", cluster: str = "cluster", limit: int = 20_000
) -> DataFrame:
    """Add ``silhouette`` to each row of a sample of at most ``limit`` rows; null for a null vector.

    The sample (rows x dimensions) goes to every executor once; each task
    compares its own rows with it. It has at most ``MAX_CENTROID_VALUES`` numbers: wide sparse rows
    have ``sparse.silhouettes``.
    """
    spark = sample.sparkSession
    known = sample.filter(F.col(vec).isNotNull() & F.col(cluster).isNotNull())
    numbers = known.limit(limit + 1).agg(F.sum(F.size(vec))).first()[0] or 0
    if numbers > MAX_CENTROID_VALUES:
        raise ValueError(f"{numbers} numbers in the sample, at most {MAX_CENTROID_VALUES} are sent to every task: use sparse rows")
    rows = bounded_rows(known.select(vectors.as_double(F.col(vec)).alias("v"), F.col(cluster).alias("c")), limit)
    if rows is None:
        raise ValueError(f"a silhouette compares every two rows: draw a sample of at most {limit}")
    if not rows:
        return sample.withColumn("silhouette", F.lit(None).cast("double"))
    names, codes = np.unique([row["c"] for row in rows], return_inverse=True)
    shared = spark.sparkContext.broadcast(
        (np.array([row["v"] for row in rows], dtype=np.float64), names, codes)
    )

    @F.arrow_udf("double")
    def score(vecs: pa.Array, clusters: pa.Array) -> pa.Array:
        table, names, codes = shared.value
        if not len(vecs):
            return pa.array([], pa.float64())
        valid = np.flatnonzero(np.asarray(vecs.is_valid()))
        if not len(valid):
            return pa.nulls(len(vecs), pa.float64())
        points = np.asarray(vecs.flatten(), dtype=np.float64).reshape(len(valid), -1)
        own = np.searchsorted(names, np.asarray(clusters.take(pa.array(valid))))
        sizes = np.bincount(codes, minlength=len(names))
        result = np.zeros(len(points))
        for i, point in enumerate(points):
            gaps = np.sqrt(((table - point) ** 2).sum(axis=1))
            totals = np.bincount(codes, weights=gaps, minlength=len(names))
            if sizes[own[i]] < 2 or len(names) < 2:
                continue
            inner = totals[own[i]] / (sizes[own[i]] - 1)
            outer = np.delete(totals / sizes, own[i]).min()
            largest = max(inner, outer)
            result[i] = (outer - inner) / largest if largest > 0 else 0.0
        scores = np.full(len(vecs), np.nan)
        scores[valid] = result
        return pa.array(scores, from_pandas=True)

    return sample.withColumn(
        "silhouette", score(vectors.as_double(F.col(vec)), F.col(cluster))
    )


def silhouette(
    assigned: DataFrame, sample_size: int = 1000, seed: int = 0, id_col: str = "doc_id", vec: str = "vec"
) -> DataFrame:
    """Mean euclidean silhouette of a repeatable sample."""
    scored = silhouettes(silhouette_sample(assigned, sample_size, seed, id_col), vec)
    return scored.agg(F.avg("silhouette").alias("silhouette"))


def squared_silhouette(assigned: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    """Silhouette of all rows by squared distance, linear in the data: a different number."""
    return ClusteringEvaluator(featuresCol=features, predictionCol=cluster).evaluate(assigned)


# --- two clusterings against each other ---
# Cells are (pair, a, b, n). Their number is bounded by the cluster counts, not by the rows.


def pair_contingency(assignments: DataFrame, methods: list[str]) -> DataFrame:
    """Joint counts for every two of the assignment columns, in one pass over the rows. Clusters keep
    their type where the columns share one, and are named by text otherwise."""
    kinds = {assignments.schema[name].dataType for name in methods}
    kind = kinds.pop() if len(kinds) == 1 else "string"
    pairs = F.array(*[
        F.struct(
            F.lit(f"{first}~{second}").alias("pair"),
            F.col(first).cast(kind).alias("a"),
            F.col(second).cast(kind).alias("b"),
        )
        for first, second in combinations(methods, 2)
    ])
    return (
        assignments.select(F.inline(pairs)).groupBy("pair", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    )


def contingency(left: DataFrame, right: DataFrame, id_col: str = "doc_id", pair: str = "pair") -> DataFrame:
    """Joint counts of two assignment tables, matched by id."""
    joined = left.select(id_col, F.col("cluster").alias("a")).join(
        right.select(id_col, F.col("cluster").alias("b")), id_col
    )
    return joined.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(pair).alias("pair"), "a", "b", "n"
    )


def _margin(cells: DataFrame, side: str) -> DataFrame:
    return cells.groupBy("pair", side).agg(F.sum("n").alias(f"n_{side}"))


def _totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("pair").agg(F.sum("n").alias("total"))


def summarise(cells: DataFrame) -> DataFrame:
    """(pair, total, both, in_a, in_b, mi, h_a, h_b): all sums the scores need, in one pass.

    With the margins beside each cell the sums over rows and columns are sums over
    cells: a row's n_a(n_a - 1)/2 is the sum of n(n_a - 1)/2 over its cells, and
    likewise its share of the entropy.
    """

    def total_over(side: str) -> Column:
        return F.sum("n").over(Window.partitionBy("pair", side)).cast("double")

    placed = cells.select(
        "pair",
        F.col("n").cast("double").alias("n"),
        total_over("a").alias("n_a"),
        total_over("b").alias("n_b"),
    ).join(F.broadcast(_totals(cells)), "pair")  # one row per pair of clusterings
    n, n_a, n_b, total = (F.col(name) for name in ("n", "n_a", "n_b", "total"))
    return placed.groupBy("pair").agg(
        F.max(total).alias("total"),
        F.sum(n * (n - 1) / 2).alias("both"),
        F.sum(n * (n_a - 1) / 2).alias("in_a"),
        F.sum(n * (n_b - 1) / 2).alias("in_b"),
        F.sum(n / total * F.log(total * n / (n_a * n_b))).alias("mi"),
        (-F.sum(n / total * F.log(n_a / total))).alias("h_a"),
        (-F.sum(n / total * F.log(n_b / total))).alias("h_b"),
    )


def _ari() -> Column:
    total = F.col("total").cast("double")
    expected = F.try_divide(F.col("in_a") * F.col("in_b"), total * (total - 1) / 2)
    divisor = (F.col("in_a") + F.col("in_b")) / 2.0 - expected
    return F.when(F.coalesce(divisor, F.lit(0.0)) == 0, 1.0).otherwise(
        F.try_divide(F.col("both") - expected, divisor)
    )


def _mean_entropy(average: str) -> Column:
    h_a, h_b = F.col("h_a"), F.col("h_b")
    return {
        "arithmetic": (h_a + h_b) / 2.0,
        "geometric": F.sqrt(h_a * h_b),
        "max": F.greatest(h_a, h_b),
    }[average]


def _both_trivial() -> Column:
    return (F.col("h_a") == 0) & (F.col("h_b") == 0)


def _nmi(average: str) -> Column:
    mean = _mean_entropy(average)
    return F.when(_both_trivial(), 1.0).when(mean == 0, 0.0).otherwise(F.try_divide("mi", mean))


def _ami(average: str) -> Column:
    return F.when(_both_trivial(), 1.0).otherwise(
        F.try_divide(F.col("mi") - F.col("emi"), _mean_entropy(average) - F.col("emi"))
    )


def adjusted_rand(cells: DataFrame) -> DataFrame:
    """(pair, ari); 1 when the divisor is 0."""
    return summarise(cells).select("pair", _ari().alias("ari"))


def normalised_mutual_information(cells: DataFrame, average: str = "arithmetic") -> DataFrame:
    """(pair, nmi); 1 when both entropies are 0. ``average`` is ``arithmetic``, ``geometric`` or
    ``max``."""
    return summarise(cells).select("pair", _nmi(average).alias("nmi"))


def overlap_information(a: int, b: int, total: int, low: int, high: int, block: int) -> float:
    """Expected share of two clusters of sizes a and b in the mutual information: over their overlap n the
    mean of n/total log(total n / (a b)) by the hypergeometric law.

    Chances go from the likeliest overlap up and down by their ratio, and are divided by their sum, so no
    factorial of a large number is needed. ``block`` overlaps are worked on at a time."""
    likeliest = min(max((a + 1) * (b + 1) // (total + 2), low), high)
    weight = value = 0.0
    for start, end, step in ((likeliest, high, 1), (likeliest, low, -1)):
        log, first = 0.0, start
        while first != end + step:
            last = min(first + block, end) if step > 0 else max(first - block, end)
            n = np.arange(first, last + step, step, dtype=np.float64)
            here = n[:-1]
            if step > 0:
                ratios = (a - here) * (b - here) / ((here + 1.0) * (total - a - b + here + 1.0))
            else:
                ratios = here * (total - a - b + here) / ((a - here + 1.0) * (b - here + 1.0))
            logs = log + np.r_[0.0, np.cumsum(np.log(ratios))]
            # The likeliest overlap is in the run upwards, and the last of a block starts the next.
            fresh = slice(0 if step > 0 and first == start else 1, None)
            chances, counts = np.exp(logs[fresh]), n[fresh]
            known = counts > 0
            weight += chances.sum()
            value += (chances[known] * counts[known] * np.log(total * counts[known] / (float(a) * b))).sum()
            if last == end:
                break
            log, first = logs[-1], last
    return value / weight / total


def _size_blocks(cells: DataFrame, side: str, most: int) -> DataFrame:
    """(pair, block, sizes): the distinct sizes of the clusters of a side with their number, ``most`` or so to a
    block."""
    sizes = _margin(cells, side).groupBy("pair", F.col(f"n_{side}").alias("size")).agg(F.count(F.lit(1)).alias("m"))
    sizes = written(sizes, "sizes")
    blocks = max(1, -(-sizes.count() // most))
    listed = F.collect_list(F.struct("size", "m")).alias(f"sizes_{side}")
    return sizes.groupBy("pair", F.pmod(F.xxhash64("size"), F.lit(blocks)).alias(f"block_{side}")).agg(listed)


def expected_information(
    cells: DataFrame, block: int = 1 << 14, deviations: float | None = 40.0, sizes: int = 256
) -> DataFrame:
    """(pair, emi): mutual information expected of random clusterings with the same sizes.

    A mean over every possible overlap of every two cluster sizes; equal sizes are computed once.
    Overlaps further than 40 deviations + 200 from the mean have a probability below e^-300, nothing in
    doubles, so the range follows the deviation and not the cluster size; None sums all, for comparison.

    The grid of sizes is cut into blocks of ``sizes`` by ``sizes``. Only blocks are joined, and dealt over
    all tasks, so neither the number of pairs of clusterings nor that of sizes decides how many tasks work.
    """
    grid = _size_blocks(cells, "a", sizes).join(_size_blocks(cells, "b", sizes), "pair")
    grid = grid.join(F.broadcast(_totals(cells)), "pair")  # one row per pair of clusterings
    dealt = grid.repartition("pair", "block_a", "block_b").select("pair", "sizes_a", "sizes_b", "total")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for left, right, total in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                emi = 0.0
                for one, other in product(left, right):
                    a, b = one["size"], other["size"]
                    low, high = max(0, a + b - total), min(a, b)
                    if deviations is not None:
                        mean = a * b / total
                        reach = deviations * math.sqrt(mean * (total - a) / total * (total - b) / max(total - 1, 1)) + 200.0
                        low, high = max(low, math.floor(mean - reach)), min(high, math.ceil(mean + reach))
                    emi += one["m"] * other["m"] * overlap_information(a, b, total, low, high, block)
                found.append(emi)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["pair", "emi"])

    kind = cells.schema["pair"].dataType.simpleString()
    return dealt.mapInArrow(run, f"pair {kind}, emi double").groupBy("pair").agg(F.sum("emi").alias("emi"))


def adjusted_mutual_information(cells: DataFrame, average: str = "arithmetic") -> DataFrame:
    """(pair, ami); 1 when both clusterings are trivial and so equal."""
    joined = summarise(cells).join(expected_information(cells), "pair")
    return joined.select("pair", _ami(average).alias("ami"))


def compare_clusterings(cells: DataFrame, average: str = "arithmetic") -> DataFrame:
    """(pair, ami, nmi, ari)."""
    joined = summarise(cells).join(expected_information(cells), "pair")
    return joined.select(
        "pair", _ami(average).alias("ami"), _nmi(average).alias("nmi"), _ari().alias("ari")
    )
