"""One round of k-means against plain arithmetic."""

from fractions import Fraction

import numpy as np

from doclens.operators import clustering as K


def test_assignment_in_parts_is_that_of_the_whole():
    rows = np.random.default_rng(1).normal(size=(3 * K._CACHED // 16 + 5, 16))
    centers = np.r_[rows[:4], rows[:1]]  # the last equals the first: the lowest number wins
    whole = np.stack([((rows - c) ** 2).sum(axis=1) for c in centers]).argmin(axis=0)
    assert (K._nearest_rows(rows, centers, "euclidean") == whole).all() and whole.max() == 3


def test_round_sums_are_exact(spark):
    """Clusters 0 and 2 of three, in mixed order: sums to the last unit, the empty one is no row."""
    points = [(i, [float(v), float(i % 7) / 8]) for i, v in enumerate([5.25, -3.5, 5.0, -3.0, 5.5, -2.75] * 40)]
    rows = spark.createDataFrame(points, "id long, _v array<double>").repartition(3).select("_v")
    found = K._round_sums(rows, [[5.0, 0.0], [99.0, 99.0], [-3.0, 0.0]], "euclidean", unit := K.sum_unit(rows))
    sums = {r["cluster"]: (r["n"], K._total(np.array(r["limbs"]).reshape(3, -1), unit).tolist()) for r in found}
    sides = {0: [v for _, v in points if v[0] > 0], 2: [v for _, v in points if v[0] < 0]}
    assert sums == {c: (len(vs), [float(sum(map(Fraction, x))) for x in zip(*vs)]) for c, vs in sides.items()}
