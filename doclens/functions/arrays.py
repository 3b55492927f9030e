"""Array expressions: run lengths, padding, decoder inputs, literals."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from doclens.schemas import GO, PAD


def literal_array(values: list, type_: str) -> Column:
    """A constant array. Spark folds it at planning, so an index into it is a plain array read."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), type_)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Inside a lambda, an outer expression is computed again for every element.
    Binding it to a lambda variable first avoids that.
    """
    return F.get(F.transform(F.array(value), body), 0)


def run_lengths(values: Column) -> Column:
    """``array<struct<value, n>>``: each distinct value of an array and how often it occurs.

    Counting inside the row saves the shuffle that explode + groupBy would need.
    One sort, then linear passes.
    """

    def run_starts(ordered: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1),
            lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
        )

    def count(ordered: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(ordered)))
        return F.zip_with(
            starts,
            ends,
            lambda start, end: F.struct(
                F.get(ordered, start).alias("value"), (end - start).cast("long").alias("n")
            ),
        )

    counted = let(
        F.sort_array(values),
        lambda ordered: let(run_starts(ordered), lambda starts: count(ordered, starts)),
    )
    return F.when(F.size(values) > 0, counted).otherwise(F.slice(counted, 1, 0))


def left_pad(ids: Column, length: Column) -> Column:
    """PAD symbols in front, up to ``length``."""
    return F.concat(F.array_repeat(F.lit(PAD), length - F.size(ids)), ids)


def decoder_input(ids: Column, length: Column) -> Column:
    """GO, the ids, then PAD symbols up to ``length``."""
    return F.concat(
        F.array(F.lit(GO)), ids, F.array_repeat(F.lit(PAD), length - F.size(ids) - 1)
    )


def target_weights(decoder: Column, length: Column) -> Column:
    """1 where the next decoder symbol is a real one; 0 at padding and at the last position."""
    return F.transform(
        F.sequence(F.lit(1), length),
        lambda i: F.when((i == length) | (F.get(decoder, i) == PAD), F.lit(0.0))
        .otherwise(F.lit(1.0))
        .cast("float"),
    )


def inference_decoder(length: Column) -> Column:
    """Decoder input when the model feeds itself: GO everywhere."""
    return F.array_repeat(F.lit(GO), length)


def inference_weights(ids: Column, length: Column) -> Column:
    """1 for the first ``size(ids)`` positions, then 0."""
    return F.concat(
        F.array_repeat(F.lit(1.0).cast("float"), F.size(ids)),
        F.array_repeat(F.lit(0.0).cast("float"), length - F.size(ids)),
    )


def transpose(rows: Column, length: Column) -> Column:
    """Rows of equal length to columns: batch-major to time-major."""
    return F.transform(
        F.sequence(F.lit(0), length - 1), lambda i: F.transform(rows, lambda row: F.get(row, i))
    )
