"""Padded batches for training and inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions import arrays, sampling
from doclens.operators.lengths import (
    assign_buckets,
    batch_buckets,
    bucket_of,
    bucket_size_of,
    bucket_stats,
)
from doclens.operators.numbering import hashed_row_numbers
from doclens.schemas import BUCKETS


def training_rows(bucketed: DataFrame, ids: str = "ids") -> DataFrame:
    """Add ``encoder``, ``decoder`` and ``weights`` of the row's bucket length."""
    length = F.col("bucket_len")
    return (
        bucketed.withColumn("encoder", arrays.left_pad(F.col(ids), length))
        .withColumn("decoder", arrays.decoder_input(F.col(ids), length))
        .withColumn("weights", arrays.target_weights(F.col("decoder"), length))
    )


def inference_rows(bucketed: DataFrame, ids: str = "ids") -> DataFrame:
    """As ``training_rows`` for a model that feeds itself: decoder all GO, weights by length."""
    length = F.col("bucket_len")
    return (
        bucketed.withColumn("encoder", arrays.left_pad(F.col(ids), length))
        .withColumn("decoder", arrays.inference_decoder(length))
        .withColumn("weights", arrays.inference_weights(F.col(ids), length))
    )


def epoch_batches(
    bucketed: DataFrame, batch_size: int = 32, seed: int = 0, key: str = "doc_id"
) -> DataFrame:
    """One epoch without replacement: rows of a bucket in hash order, cut into batches.

    Adds ``batch``, counted from 0 inside each bucket, and ``slot``.
    """
    hashed = bucketed.withColumn("_hex", sampling.hash_hex(seed, F.col(key)))
    numbered = hashed_row_numbers(hashed, "_hex", [key], ["bucket_id"], "_rn")
    place = F.col("_rn") - 1
    return (
        numbered.withColumn("batch", F.floor(place / batch_size))
        .withColumn("slot", (place % batch_size).cast("int"))
        .drop("_hex", "_rn")
    )


def shuffled_batches(
    docs: DataFrame, batch_size: int, num_epochs: int, seed: int = 0, key: str = "doc_id"
) -> DataFrame:
    """Add ``epoch`` and ``batch``: every epoch shuffles all rows anew by a seeded hash.

    Endless repetition is not offered; ``num_epochs`` must be 1 or more.
    """
    if num_epochs < 1:
        raise ValueError("num_epochs must be 1 or more")
    repeated = docs.withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(num_epochs - 1)))
    ).withColumn("_hex", sampling.hash_hex(seed, F.col("epoch"), F.col(key)))
    numbered = hashed_row_numbers(repeated, "_hex", [key], ["epoch"], "_rn")
    return numbered.withColumn("batch", F.floor((F.col("_rn") - 1) / batch_size)).drop(
        "_hex", "_rn"
    )


def sample_buckets(shares: DataFrame, steps: int, seed: int = 0) -> DataFrame:
    """(step, bucket_id): each step draws the smallest bucket whose running share exceeds a
    uniform number. The shares, one row per bucket, become one array."""
    spark = shares.sparkSession
    ladder = shares.agg(
        F.array_sort(F.collect_list(F.struct("share", "bucket_id"))).alias("ladder")
    ).scalar()
    drawn = (
        spark.range(steps)
        .select(F.col("id").alias("step"), sampling.hash_unit(seed, F.col("id")).alias("u"))
        .withColumn("_ladder", ladder)
    )
    above = F.filter("_ladder", lambda rung: rung["share"] > F.col("u"))
    return drawn.select("step", F.get(above, 0)["bucket_id"].alias("bucket_id"))


def sample_batches(
    bucketed: DataFrame,
    steps: int,
    batch_size: int = 32,
    seed: int = 0,
    key: str = "doc_id",
) -> DataFrame:
    """(step, slot, bucket_id, ...row): per step a bucket by share, then ``batch_size`` rows of it
    with replacement.

    Rows are numbered inside their bucket by key alone; a draw picks a number, so the keys meet
    the draws in an equi-join on (bucket, number), which spreads evenly. Only what was drawn is
    fetched from ``bucketed``, whose ``key`` must be unique.
    """
    stats = bucket_stats(bucketed)
    steps_table = sample_buckets(stats, steps, seed)
    # One row per bucket.
    drawn = steps_table.join(F.broadcast(stats.select("bucket_id", "n")), "bucket_id")
    draws = drawn.select(
        "step", "bucket_id", "n", F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1))).alias("slot")
    )
    u = sampling.hash_unit(seed + 1, F.col("step"), F.col("slot"))
    draws = draws.select(
        "step", "slot", "bucket_id", (F.floor(u * F.col("n")) + 1).alias("_rn")
    )
    hashed = bucketed.select("bucket_id", key, sampling.hash_hex(seed, F.col(key)).alias("_hex"))
    numbered = hashed_row_numbers(hashed, "_hex", [key], ["bucket_id"], "_rn").drop("_hex")
    drawn_keys = draws.join(numbered, ["bucket_id", "_rn"]).drop("_rn")
    return drawn_keys.join(bucketed, ["bucket_id", key])


def time_major(
    batched: DataFrame,
    values: str,
    groups: Sequence[str] = ("bucket_id", "batch"),
    slot: str = "slot",
    length: str = "bucket_len",
) -> DataFrame:
    """(groups, pos, column): position by position over the rows of a batch.

    Only whole rows are shuffled, one group per batch of bounded size; the
    transposition happens inside the row.
    """
    rows = batched.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct(slot, values))).alias("_rows"),
        F.max(length).alias("_length"),
    )
    plain = rows.withColumn("_rows", F.transform("_rows", lambda r: r[values]))
    turned = plain.select(*groups, arrays.transpose(F.col("_rows"), F.col("_length")).alias("_turned"))
    return turned.select(*groups, F.posexplode("_turned").alias("pos", "column"))


def pad_and_bucket(docs: DataFrame, batch: str = "batch", ids: str = "ids") -> DataFrame:
    """Left-pad every row to the bucket of its batch; rows of batches that fit none go."""
    sizes = batch_buckets(docs, F.size(ids), batch).filter(F.col("bucket_id").isNotNull())
    return docs.join(sizes, batch).withColumn(
        "encoder", arrays.left_pad(F.col(ids), F.col("bucket_len"))
    )


def length_violations(rows: DataFrame) -> DataFrame:
    """Per bucket: rows, and how many arrays do not have the bucket's length (all should be 0)."""

    def wrong(name: str) -> Column:
        return F.count_if(F.size(name) != F.col("bucket_len")).alias(f"bad_{name}")

    return rows.groupBy("bucket_id").agg(
        F.count(F.lit(1)).alias("n"), wrong("encoder"), wrong("decoder"), wrong("weights")
    )


def bucketed(docs: DataFrame, ids: str = "ids", buckets: Sequence[int] = BUCKETS) -> DataFrame:
    return assign_buckets(docs, F.size(ids), buckets)


__all__ = [
    "batch_buckets",
    "bucket_of",
    "bucket_size_of",
    "bucketed",
    "epoch_batches",
    "inference_rows",
    "length_violations",
    "pad_and_bucket",
    "sample_batches",
    "sample_buckets",
    "shuffled_batches",
    "time_major",
    "training_rows",
]
