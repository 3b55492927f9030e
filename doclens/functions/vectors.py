"""Vector arithmetic on ``array<double>`` columns, and the distance registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens.functions.arrays import let

DistanceFunction = Callable[[Column, Column], Column]


def as_double(vec: Column) -> Column:
    """Widen before any sum: float32 totals drift."""
    return vec.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x * x))


def normalise(a: Column) -> Column:
    """Divide by the l2 norm; a zero vector stays zero."""
    return let(
        l2_norm(a),
        lambda norm: F.when(norm > 0, F.transform(a, lambda x: x / norm)).otherwise(a),
    )


def cosine_similarity(a: Column, b: Column) -> Column:
    """Row-wise cosine; 0 when either vector is zero."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine_similarity(a, b)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


# A distance is a name or any function of two array columns; smaller is nearer.
DISTANCES: dict[str, DistanceFunction] = {
    "euclidean": euclidean_distance,
    "cosine": cosine_distance,
}


def distance_function(distance: str | DistanceFunction) -> DistanceFunction:
    return distance if callable(distance) else DISTANCES[distance]


def argmin(values: Column) -> Column:
    """Zero-based place of the smallest value, the first one on ties."""
    return let(values, lambda v: (F.array_position(v, F.array_min(v)) - 1).cast("int"))


def argmax(values: Column) -> Column:
    """Zero-based place of the largest value, the first one on ties."""
    return let(values, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def softmax(logits: Column) -> Column:
    """Shifted by the largest logit, so it cannot overflow."""
    powers = let(
        F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top))
    )
    return let(
        powers, lambda ps: let(_total(ps), lambda total: F.transform(ps, lambda p: p / total))
    )
