"""Row numbers and running sums over whole tables, without a single-task window."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.session import written

_SLICE, _BEFORE = "_slice", "_before"


def _number_slices(placed: DataFrame, order: Sequence[Column], keys: Sequence[str], out: str) -> DataFrame:
    """Number inside each slice, then add the sizes of the slices before it.

    The sizes table has one row per (key, slice), so its own window is small.
    """
    sizes = placed.groupBy(*keys, _SLICE).agg(F.count(F.lit(1)).alias("_size"))
    earlier = (
        Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    )
    before = sizes.select(
        *keys, _SLICE, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias(_BEFORE)
    )
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*order)
    return (
        placed.withColumn(out, F.row_number().over(inside).cast("long"))
        .join(before, [*keys, _SLICE])
        .withColumn(out, F.col(out) + F.col(_BEFORE))
        .drop(_SLICE, _BEFORE)
    )


def row_numbers(
    df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), out: str = "row_no"
) -> DataFrame:
    """``row_number() over (partition by keys order by order)``, 1-based, for groups of any size.

    Rows are range-partitioned on keys and order, so one key holding most rows
    is spread over many tasks. The slices are written once, because a second
    sampling of the ranges could cut elsewhere. ``order`` must be unique per key.
    """
    spark = df.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(slices, *[F.col(key) for key in keys], *order).withColumn(
        _SLICE, F.spark_partition_id()
    )
    return _number_slices(written(placed, "numbering"), order, keys, out)


def hashed_row_numbers(
    df: DataFrame, hex_digits: str, tie: Sequence[str], keys: Sequence[str] = (), out: str = "row_no"
) -> DataFrame:
    """Row numbers in the order of a hash column of hex digits. Its leading digits already cut even
    slices, at least eight per shuffle partition, so nothing is written."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = max(2, math.ceil(math.log(8 * partitions, 16)))
    placed = df.withColumn(_SLICE, F.substring(hex_digits, 1, digits))
    return _number_slices(placed, [F.col(hex_digits), *map(F.col, tie)], keys, out)


def running_sum(
    df: DataFrame, position: str, value: str, out: str, block: int = 1 << 16
) -> DataFrame:
    """Sum of ``value`` up to and including each row; ``position`` counts 1, 2, 3...

    Sums inside blocks run in parallel; only the block totals meet in one window.
    """
    blocked = df.withColumn("_block", F.floor((F.col(position) - 1) / block))
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_total"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias(_BEFORE)
    )
    inside = (
        Window.partitionBy("_block")
        .orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        blocked.withColumn(out, F.sum(value).over(inside))
        .join(before, "_block")
        .withColumn(out, F.col(out) + F.col(_BEFORE))
        .drop("_block", _BEFORE)
    )
