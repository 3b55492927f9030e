"""Length filters and length buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.schemas import BUCKETS


def filter_length(docs: DataFrame, max_len: int = 200, length: Column | None = None) -> DataFrame:
    """Documents shorter than ``max_len`` tokens."""
    return docs.filter((F.size("tokens") if length is None else length) < max_len)


def filter_encodable(docs: DataFrame, max_len: int = BUCKETS[-1], length: Column | None = None) -> DataFrame:
    """Documents of at most ``max_len`` tokens: the encoder's own limit includes it."""
    return docs.filter((F.size("tokens") if length is None else length) <= max_len)


def bucket_of(length: Column, buckets: Sequence[int] = BUCKETS) -> Column:
    """Number of the first bucket larger than the length; null when none is."""
    number = F.when(length < buckets[0], 0)
    for bucket_id, size in enumerate(buckets[1:], start=1):
        number = number.when(length < size, bucket_id)
    return number.cast("int")


def bucket_or_missing(length: Column, buckets: Sequence[int] = BUCKETS) -> Column:
    """As ``bucket_of``, with -1 when no bucket fits."""
    return F.coalesce(bucket_of(length, buckets), F.lit(-1))


def batch_bucket_of(longest: Column, buckets: Sequence[int] = BUCKETS) -> Column:
    """Bucket of a batch by its longest row; exactly the last size still fits the last bucket."""
    return F.when(longest == buckets[-1], len(buckets) - 1).otherwise(
        bucket_of(longest, buckets)
    ).cast("int")


def bucket_size_of(bucket_id: Column, buckets: Sequence[int] = BUCKETS) -> Column:
    return F.get(F.array(*[F.lit(size) for size in buckets]), bucket_id)


def assign_buckets(
    docs: DataFrame, length: Column, buckets: Sequence[int] = BUCKETS
) -> DataFrame:
    """Add ``bucket_id`` and ``bucket_len``; rows that fit no bucket go."""
    return (
        docs.withColumn("bucket_id", bucket_of(length, buckets))
        .filter(F.col("bucket_id").isNotNull())
        .withColumn("bucket_len", bucket_size_of(F.col("bucket_id"), buckets))
    )


def bucket_stats(bucketed: DataFrame) -> DataFrame:
    """(bucket_id, n, total, share): share of this and all smaller buckets. As many rows as buckets."""
    sizes = bucketed.groupBy("bucket_id").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.orderBy("bucket_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("bucket_id").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    return sizes.select(
        "bucket_id",
        "n",
        F.sum("n").over(whole).alias("total"),
        (F.sum("n").over(so_far) / F.sum("n").over(whole)).alias("share"),
    )


def batch_buckets(batched: DataFrame, length: Column, batch: str = "batch") -> DataFrame:
    """(batch, longest, bucket_id, bucket_len): one bucket for each batch. A batch longer than
    every bucket has a null bucket."""
    longest = batched.groupBy(batch).agg(F.max(length).alias("longest"))
    return longest.withColumn("bucket_id", batch_bucket_of(F.col("longest"))).withColumn(
        "bucket_len", bucket_size_of(F.col("bucket_id"))
    )
