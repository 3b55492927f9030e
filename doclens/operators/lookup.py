"""Lookups of skewed values in fitted tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.session import MAX_BROADCAST_ROWS, written


def bounded_rows(table: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> list | None:
    """The rows of a fitted table, or None when there are more than ``limit``. Counted first, so a
    table that is too large never reaches the driver; pass a written table."""
    return None if table.limit(limit + 1).count() > limit else table.collect()


def with_row_number(df: DataFrame, out: str) -> DataFrame:
    """Add a number that is unique per row, repeated rows included. Written, so that it cannot change
    between two uses."""
    return written(df.withColumn(out, F.monotonically_increasing_id()), "rows")


def index_lookup(spark, symbols: list[str], ids: list[int], missing: int):
    """``array<string> -> array<int>``, one Arrow hash lookup per batch of rows.

    The table must be small (see ``bounded_rows``); it is broadcast once. The rows stay where
    they are: no explode, join and regroup, hence no shuffle of the corpus. Marked as
    non-deterministic, so that a filter on the ids stays above the lookup and does not
    repeat it (and the tokeniser) below; put filters on other columns first.
    """
    table = spark.sparkContext.broadcast(
        (pa.array(symbols, pa.string()), pa.array(ids, pa.int32()))
    )

    @F.arrow_udf("array<int>")
    def lookup(tokens: pa.Array) -> pa.Array:
        known, known_ids = table.value
        found = pc.index_in(tokens.flatten(), value_set=known)
        flat = pc.fill_null(pc.take(known_ids, found), pa.scalar(missing, pa.int32()))
        sizes = pc.fill_null(pc.list_value_length(tokens), 0)
        ends = pc.cumulative_sum(pc.cast(sizes, pa.int32()))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, flat)

    return lookup.asNondeterministic()


def known_or(spark, symbols: list[str], other: str):
    """``array<string> -> array<string>``: ``other`` in place of every value that is not one of ``symbols``.

    Broadcast, and marked as non-deterministic, like ``index_lookup``."""
    table = spark.sparkContext.broadcast(pa.array(symbols, pa.string()))

    @F.arrow_udf("array<string>")
    def lookup(tokens: pa.Array) -> pa.Array:
        flat = tokens.flatten()
        values = pc.if_else(pc.is_in(flat, value_set=table.value), flat, pa.scalar(other, flat.type))
        ends = pc.cumulative_sum(pc.cast(pc.fill_null(pc.list_value_length(tokens), 0), pa.int32()))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, values, mask=pc.is_null(tokens))

    return lookup.asNondeterministic()


def frequent_keys(facts: DataFrame, key: str, capacity: int = 10_000) -> DataFrame:
    """(key, at_least): every key on more than 2 / ``capacity`` of the rows, and at most ``capacity`` keys.

    A counter summary by Misra and Gries: each task keeps at most ``capacity`` counters and lowers all
    when there are more, which takes at most 1 / ``capacity`` of its rows off any key; the summaries are
    added. So ``at_least`` is never above the true count, and memory follows the capacity, not the keys.
    Null keys are left out.
    """
    kind = facts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, rows = None, np.zeros(0, np.int64), 0
        for batch in batches:
            column = batch.column(0).drop_null()
            rows += len(column)
            if keys is not None:
                column, more = pa.concat_arrays([keys, column]), np.r_[counts, np.ones(len(column), np.int64)]
            else:
                more = np.ones(len(column), np.int64)
            coded = column.dictionary_encode()
            keys = coded.dictionary
            counts = np.bincount(coded.indices.to_numpy(), more, minlength=len(keys)).astype(np.int64)
            if len(keys) > capacity:
                counts = counts - np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1]
                left = np.flatnonzero(counts > 0)
                keys, counts = keys.take(pa.array(left)), counts[left]
        if keys is not None:
            yield pa.RecordBatch.from_arrays([keys, pa.array(counts)], ["_key", "_n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, keys.type), pa.array([rows])], ["_key", "_n"])

    summaries = facts.select(key).mapInArrow(run, f"_key {kind}, _n bigint").groupBy("_key").agg(F.sum("_n").alias("_n"))
    added = written(summaries, "frequent")
    total = added.filter(F.col("_key").isNull()).select("_n").scalar()
    return added.filter(F.col("_key").isNotNull() & (F.col("_n") > total / capacity)).select(
        F.col("_key").alias(key), F.col("_n").alias("at_least")
    )


def skew_safe_lookup(facts: DataFrame, table: DataFrame, key: str, capacity: int = 10_000) -> DataFrame:
    """Left join of skewed facts to a table with one row per ``key``, of any size.

    The keys that are frequent among the facts, whether the table has them or not, are looked up in a
    broadcast of at most ``capacity`` rows; their rows are not shuffled. Of the others none is on more than
    2 / ``capacity`` of the rows, and those are joined by shuffle. Facts are read three times; null keys
    match nothing and stay with the broadcast.
    """
    frequent = written(frequent_keys(facts, key, capacity).select(key), "hot")
    hot = frequent.join(table, key, "left").withColumn("_hot", F.lit(True))
    cold = table.join(F.broadcast(frequent), key, "left_anti")
    marked = facts.join(F.broadcast(hot), key, "left")
    here = F.col("_hot").isNotNull() | F.col(key).isNull()
    matched = marked.filter(here).drop("_hot")
    rest = marked.filter(~here).select(*facts.columns)
    return matched.select(*facts.columns, *[c for c in table.columns if c != key]).unionByName(rest.join(cold, key, "left"))


def unnest(df: DataFrame, keep: list[str], values: Column, *names: str) -> DataFrame:
    """One row per element of an array; two names give (position, element).

    The outer form with a filter after it: for the inner form the optimiser adds a
    size check below, which computes an expression such as a tokeniser twice.
    """
    if len(names) == 2:
        rows = df.select(*keep, F.posexplode_outer(values).alias(*names))
    else:
        rows = df.select(*keep, F.explode_outer(values).alias(names[0]))
    return rows.filter(F.col(names[-1]).isNotNull())
