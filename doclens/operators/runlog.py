"""Analytics over a training log: rows of (step, loss, step_time), steps counted from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.functions import sampling, vectors
from doclens.operators.numbering import row_numbers, running_sum


def number_steps(log: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``step`` from 0 in the given order, which must be unique."""
    return row_numbers(log, order, out="step").withColumn("step", F.col("step") - 1)


def checkpoint_rollup(log: DataFrame, per: int = 200) -> DataFrame:
    """(checkpoint, loss, step_time, perplexity) for every full group of ``per`` steps.

    Perplexity is exp(loss), infinite from a loss of 300 on.
    """
    groups = log.groupBy(F.floor(F.col("step") / per).alias("checkpoint")).agg(
        F.avg("loss").alias("loss"),
        F.avg("step_time").alias("step_time"),
        F.count(F.lit(1)).alias("_n"),
    )
    perplexity = F.when(F.col("loss") < 300, F.exp("loss")).otherwise(float("inf"))
    return (
        groups.filter(F.col("_n") == per)
        .drop("_n")
        .withColumn("perplexity", perplexity)
    )


def plateau_drops(
    checkpoints: DataFrame, rate: float = 0.01, decay: float = 0.9, look_back: int = 3
) -> DataFrame:
    """(checkpoint, loss, dropped, rate): the learning rate falls when the loss is above the
    largest of the last three recorded, once there are three. Checkpoints may be missing.

    Each checkpoint sends its loss to the next three, so no window runs over the
    whole log. ``rate`` is the one in force after the checkpoint.
    """
    placed = row_numbers(checkpoints, [F.col("checkpoint")], out="_position")
    ahead = F.sequence(F.lit(1), F.lit(look_back))
    earlier = (
        placed.select(
            F.explode(F.transform(ahead, lambda i: F.col("_position") + i)).alias("_position"),
            F.col("loss").alias("_loss"),
        )
        .groupBy("_position")
        .agg(F.max("_loss").alias("_worst"), F.count(F.lit(1)).alias("_seen"))
    )
    dropped = (F.col("_seen") == look_back) & (F.col("loss") > F.col("_worst"))
    marked = placed.join(earlier, "_position", "left").select(
        "checkpoint", "loss", F.coalesce(dropped, F.lit(False)).cast("int").alias("dropped"), "_position"
    )
    summed = running_sum(marked, "_position", "dropped", "_drops")
    return summed.select(
        "checkpoint", "loss", "dropped", (F.lit(rate) * F.pow(F.lit(decay), F.col("_drops"))).alias("rate")
    )


def first_nan(log: DataFrame) -> DataFrame:
    """(first_step, n): the first step whose loss is not a number, and how many there are."""
    return log.agg(
        F.min(F.when(F.isnan("loss"), F.col("step"))).alias("first_step"),
        F.count_if(F.isnan("loss")).alias("n"),
    )


def logit_argmax(logits: Column) -> Column:
    return vectors.argmax(logits)


def logit_sample(logits: Column, seed: int, *keys: Column) -> Column:
    """A draw from softmax(logits): the largest logit plus Gumbel noise.

    The noise is a hash of seed, keys and place, so a rerun draws the same. No
    exponential of a logit is taken, so nothing overflows.
    """
    noisy = F.transform(
        logits,
        lambda logit, place: logit
        - F.log(-F.log((sampling.hash_unit(seed, *keys, place) + 2.0**-54))),
    )
    return vectors.argmax(noisy)
