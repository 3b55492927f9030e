import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from doclens.functions import vectors
from doclens.functions.maths import log_factorial
from doclens.operators import clustering as K
from doclens.operators import evaluation as E


@pytest.fixture(scope="module")
def blobs(spark):
    """500 points around (-5, -5), then 300 around (10, 10)."""
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(-5, 1, (500, 2)), rng.normal(10, 1, (300, 2))])
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "doc_id long, vec array<double>").cache()


def test_two_blobs_from_two_seeds_in_one_blob(spark, blobs):
    model = K.kmeans_lloyd(blobs, 2)
    assert model.converged
    centers = sorted(model.centroids)
    assert centers[0] == pytest.approx([-5, -5], abs=0.3)
    assert centers[1] == pytest.approx([10, 10], abs=0.3)
    sizes = model.assignments(blobs).groupBy("cluster").count().collect()
    assert sorted(r["count"] for r in sizes) == [300, 500]


def test_library_kmeans_on_blobs(spark, blobs):
    featured = blobs.withColumn("features", array_to_vector("vec"))
    found = K.kmeans_fit(featured, 2, seed=3).transform(featured)
    assert sorted(r["count"] for r in found.groupBy("cluster").count().collect()) == [300, 500]
    assert E.squared_silhouette(found) > 0.9


def test_all_rows_in_cluster_zero_end_the_run(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [1.5])], "doc_id long, vec array<double>")
    model = K.kmeans_lloyd(rows, 2)
    assert (model.rounds, model.converged) == (1, True)
    # Cluster 1 is empty and keeps its centroid.
    assert model.centroids == [[pytest.approx(3.5 / 3)], [1.0]]


def test_ties_go_to_the_lowest_number(spark, blobs):
    same = [[0.0, 0.0], [0.0, 0.0]]
    for distance in ("euclidean", "cosine", vectors.euclidean_distance):
        found = K.assign_nearest(blobs, same, distance).select("cluster").distinct().collect()
        assert [r["cluster"] for r in found] == [0]


@pytest.mark.parametrize("distance", ["euclidean", "cosine"])
def test_arrow_and_column_distances_agree(spark, blobs, distance):
    centers = [[-4.0, -6.0], [9.0, 8.0], [1.0, -1.0]]
    both = K.assign_nearest(blobs, centers, distance, out="a")
    both = K.assign_nearest(both, centers, vectors.DISTANCES[distance], out="b")
    assert both.filter("a <> b").count() == 0


def test_vectors_of_length_zero(spark):
    row = spark.sql("SELECT array(0D, 0D) AS z, array(3D, 4D) AS v").select(
        vectors.normalise(F.col("z")).alias("nz"),
        vectors.normalise(F.col("v")).alias("nv"),
        vectors.cosine_distance(F.col("z"), F.col("v")).alias("d"),
        vectors.softmax(F.array(F.lit(1000.0), F.lit(1000.0))).alias("s"),
    ).first()
    assert row["nz"] == [0, 0] and row["nv"] == [0.6, 0.8] and row["d"] == 1 and row["s"] == [0.5, 0.5]


def test_members_keep_their_ids(spark, blobs):
    assigned = K.assign_nearest(blobs, [[-5.0, -5.0], [10.0, 10.0]])
    rows = K.cluster_members(assigned).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["cluster"], r["member_no"]))] == list(range(800))
    assert {(r["cluster"], r["size"]) for r in rows} == {(0, 500), (1, 300)}


# --- scores against labels ---


@pytest.fixture
def train(spark):
    rows = [(1, 0, ["a", "b"]), (2, 0, ["a"]), (3, 0, []), (4, 1, ["b"]), (5, 1, ["b", "c"]), (6, 2, [])]
    return spark.createDataFrame(rows, "doc_id long, cluster int, topics array<string>")


def test_purity_counts_unlabelled_documents(spark, train):
    purity = {r["cluster"]: r["purity"] for r in E.cluster_purities(train).collect()}
    assert purity == {0: pytest.approx(2 / 3), 1: 1.0, 2: 0.0}
    assert E.pseudo_purity(train).first()[0] == pytest.approx((2 / 3 + 1) / 3)


def test_hit_rate_counts_unlabelled_documents_and_repeated_labels(spark, train):
    top = E.top_labels(E.cluster_label_counts(train), 5)
    test = spark.createDataFrame(
        [(0, ["a", "x"]), (0, []), (1, ["c", "c", "y", "z"]), (2, ["a"]), (9, ["a"])],
        "cluster int, topics array<string>",
    )
    assert E.top_label_hit_rate(test, top).first()[0] == pytest.approx((0.5 + 0 + 0.5 + 0 + 0) / 5)


def test_top_labels_break_ties_by_name(spark, train):
    top = E.top_labels(E.cluster_label_counts(train), 1)
    assert {(r["cluster"], r["label"]) for r in top.collect()} == {(0, "a"), (1, "b")}


def test_choose_k(spark, train):
    assert K.choose_k(train, 0) == 3
    assert K.choose_k(train, 7) == 7


def brute_silhouette(points, clusters):
    scores = []
    for i, p in enumerate(points):
        gaps = {}
        for j, q in enumerate(points):
            if i != j:
                gaps.setdefault(clusters[j], []).append(math.dist(p, q))
        own = gaps.pop(clusters[i], [])
        if not own or not gaps:
            scores.append(0.0)
            continue
        a, b = sum(own) / len(own), min(sum(g) / len(g) for g in gaps.values())
        scores.append((b - a) / max(a, b))
    return sum(scores) / len(scores)


def test_silhouette_by_brute_force(spark):
    rng = np.random.default_rng(1)
    points = [[float(x) for x in p] for p in rng.normal(size=(60, 3))]
    clusters = [i % 4 for i in range(59)] + [7]
    rows = spark.createDataFrame(
        [(i, p, c) for i, (p, c) in enumerate(zip(points, clusters))], "doc_id long, vec array<double>, cluster int"
    )
    assert E.silhouette(rows).first()[0] == pytest.approx(brute_silhouette(points, clusters))
    assert E.silhouette_sample(rows, 10).count() == 10


# --- two clusterings ---


def cells_of(spark, a, b):
    rows = spark.createDataFrame(list(zip(a, b)), "x int, y int")
    return E.pair_contingency(rows, ["x", "y"])


def scores(spark, a, b):
    row = E.compare_clusterings(cells_of(spark, a, b)).first()
    return row["ami"], row["nmi"], row["ari"]


def test_equal_clusterings_score_one(spark):
    a = [0, 0, 1, 1, 2, 2, 2]
    assert scores(spark, a, [5 - x for x in a]) == pytest.approx((1, 1, 1))


def test_scores_are_symmetric_and_match_brute_force(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 3, 40).tolist(), rng.integers(0, 4, 40).tolist()
    ami, nmi, ari = scores(spark, a, b)
    assert scores(spark, b, a) == pytest.approx((ami, nmi, ari))
    pairs = list(combinations(range(40), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    in_a = sum(a[i] == a[j] for i, j in pairs)
    in_b = sum(b[i] == b[j] for i, j in pairs)
    expected = in_a * in_b / len(pairs)
    assert ari == pytest.approx((both - expected) / ((in_a + in_b) / 2 - expected))


def test_expected_information_by_shuffling(spark):
    rng = np.random.default_rng(3)
    a, b = np.repeat([0, 1, 2], [20, 10, 5]), np.repeat([0, 1], [25, 10])

    def mutual(x, y):
        joint = np.zeros((3, 2))
        np.add.at(joint, (x, y), 1 / len(x))
        outer = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)
        held = joint > 0
        return (joint[held] * np.log(joint[held] / outer[held])).sum()

    mean = np.mean([mutual(a, rng.permutation(b)) for _ in range(4000)])
    found = E.expected_information(cells_of(spark, a.tolist(), b.tolist())).first()["emi"]
    assert found == pytest.approx(mean, rel=0.05)
    small_blocks = E.expected_information(cells_of(spark, a.tolist(), b.tolist()), block=3).first()["emi"]
    assert small_blocks == pytest.approx(found)


def test_expected_information_of_huge_clusters(spark):
    """A million rows a cell: the sum follows the deviation, the result the known limit."""
    n = 10**9
    cells = spark.createDataFrame(
        [("p", a, b, n // 4) for a in (0, 1) for b in (0, 1)], "pair string, a int, b int, n long"
    )
    # (rows - 1)(columns - 1) / 2N for large N.
    assert E.expected_information(cells).first()["emi"] == pytest.approx(1 / (2 * n), rel=0.01)


def test_one_cluster_against_another(spark):
    assert scores(spark, [0] * 5, [1] * 5) == (1, 1, 1)
    ami, nmi, ari = scores(spark, [0] * 6, [0, 1, 2, 0, 1, 2])
    assert (nmi, ari) == (0, 0)


def test_log_factorial(spark):
    values = [0, 1, 2, 5, 20, 170, 10**6, 10**11]
    rows = spark.createDataFrame([(v,) for v in values], "n long")
    found = {r["n"]: r["x"] for r in rows.select("n", log_factorial(F.col("n")).alias("x")).collect()}
    for v in values:
        assert found[v] == pytest.approx(math.lgamma(v + 1), rel=1e-12, abs=1e-12)


def test_many_clusters(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(2000, 3))
    rows = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "doc_id long, vec array<double>")
    model = K.kmeans_lloyd(rows, 300, 200)
    assert model.converged
    centers = points[:300].copy()
    for _ in range(model.rounds):
        now = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        for c in np.unique(now):
            centers[c] = points[now == c].mean(axis=0)
    assert np.allclose(centers, model.centroids)


def test_null_vectors_are_in_no_cluster(spark):
    rows = spark.createDataFrame([(0, [0.0]), (1, None), (2, [9.0]), (3, None)], "doc_id long, vec array<double>")
    for distance in ("euclidean", vectors.euclidean_distance):
        found = {r["doc_id"]: r["cluster"] for r in K.assign_nearest(rows, [[0.0], [10.0]], distance).collect()}
        assert found == {0: 0, 1: None, 2: 1, 3: None}
    assert K.kmeans_lloyd(rows, 1).centroids == [[4.5]]
    scored = E.silhouettes(rows.withColumn("cluster", (F.col("doc_id") / 2).cast("int"))).collect()
    assert [r["silhouette"] is None for r in sorted(scored)] == [False, True, False, True]


def test_too_large_a_table_of_centroids(spark, blobs):
    with pytest.raises(ValueError, match="centroids"):
        K.checked([[0.0] * 10] * 10, 99)
    with pytest.raises(ValueError, match="sample"):
        E.silhouettes(blobs.withColumn("cluster", F.lit(1)), limit=10)


def test_first_k_reads_the_ids_first(spark, blobs):
    assert K.first_k(blobs, 3) == [list(r["vec"]) for r in blobs.orderBy("doc_id").limit(3).collect()]


def test_one_document(spark):
    cells = spark.createDataFrame([("p", 0, 0, 1)], "pair string, a int, b int, n long")
    row = E.compare_clusterings(cells).first()
    assert (row["ami"], row["nmi"], row["ari"]) == (1.0, 1.0, 1.0)
    assert E.adjusted_rand(cells).first()["ari"] == 1.0


def test_clusters_keep_their_names(spark):
    rows = spark.createDataFrame([("x", "y", 1), ("x", "z", 2)], "one string, two string, three int")
    assert {(r["a"], r["b"]) for r in E.pair_contingency(rows, ["one", "two"]).collect()} == {("x", "y"), ("x", "z")}
    assert E.pair_contingency(rows, ["one", "three"]).count() == 2


def test_far_overlaps_add_nothing(spark):
    cells = [("p", i % 7, i % 5, 900 + 37 * i) for i in range(35)] + [("q", 0, 0, 30_000), ("q", 0, 1, 5), ("q", 1, 1, 20_000)]
    table = spark.createDataFrame(cells, "pair string, a int, b int, n long")
    cut, whole = (
        {r["pair"]: r["emi"] for r in E.expected_information(table, deviations=d).collect()} for d in (40.0, None)
    )
    assert cut == pytest.approx(whole, rel=1e-12)


def test_expected_information_over_many_sizes(spark):
    """Distinct sizes on both sides: equal to the law written out, whatever the blocks, and dealt evenly."""
    from math import comb, log

    a_sizes, b_sizes = list(range(1, 25)), [3, 5, 7, 11, 13, 17, 19, 2, 4, 6, 8, 10, 205]
    total = sum(a_sizes)
    b_sizes[-1] = total - sum(b_sizes[:-1])
    cells, left = [], list(b_sizes)
    for i, size in enumerate(a_sizes):
        for j in range(len(left)):
            n = min(size, left[j])
            if n:
                cells.append(("p", i, j, n))
                size, left[j] = size - n, left[j] - n
    frame = spark.createDataFrame(cells, "pair string, a int, b int, n long")
    exact = sum(
        comb(a, n) * comb(total - a, b - n) / comb(total, b) * n / total * log(total * n / (a * b))
        for a in a_sizes for b in b_sizes for n in range(max(1, a + b - total), min(a, b) + 1)
    )
    for block, deviations, sizes in ((3, None, 4), (1 << 14, 40.0, 256), (1, 40.0, 2)):
        found = E.expected_information(frame, block, deviations, sizes).first()["emi"]
        assert found == pytest.approx(exact, rel=1e-11)


def test_overlap_information_of_large_clusters():
    """No factorials: a billion rows, against the same law summed by smaller steps."""
    a, b, total = 3 * 10**8, 5 * 10**8, 10**9
    mean, spread = a * b / total, (a * b / total * 0.7 * 0.5) ** 0.5
    low, high = int(mean - 45 * spread), int(mean + 45 * spread)
    one = E.overlap_information(a, b, total, low, high, 1 << 14)
    # second order: n/N log(Nn/ab) about the mean adds half the variance over the mean
    wanted = spread**2 / (2 * mean) / total
    assert one == pytest.approx(wanted, rel=1e-4)
    assert one == pytest.approx(E.overlap_information(a, b, total, low, high, 1000), rel=1e-9)
