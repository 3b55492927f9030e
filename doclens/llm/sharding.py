"""Shards along a Hilbert curve through several metadata dimensions. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.llm.common import let, read
from doclens.operators.numbering import row_numbers, running_sum

_INDEX = "curve_index"


def _value(df: DataFrame, name: str) -> Column:
    """A dimension in the order it is levelled by: text as it is, all else as a number, NaN as 0."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.col(name)
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(-1.0))


def _text_bounds(df: DataFrame, name: str, total: int, bits: int) -> list[str | None]:
    """The least value of a text column up to which i / 2^bits of the rows lie, for each i; nulls first.

    Values are counted, numbered in their order by ranges and summed in blocks, so any number of distinct
    ones will do; at most 2^bits - 1 rows come to the driver."""
    counts = df.groupBy(F.col(name).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
    ranked = row_numbers(counts, [F.col("_value").asc_nulls_first()], out="_at")
    upto = running_sum(ranked, "_at", "_rows", "_upto")
    low = F.expr(f"((_upto - _rows) * {2**bits}) div {total} + 1")
    high = F.least(F.expr(f"(_upto * {2**bits}) div {total}"), F.lit(2**bits - 1))
    found = upto.select("_value", low.alias("low"), high.alias("high")).filter("low <= high").collect()
    return [r["_value"] for r in sorted(found, key=lambda r: r["low"]) for _ in range(r["low"], r["high"] + 1)]


def quantile_levels(df: DataFrame, dims: Sequence[str], bits: int) -> list[Column]:
    """Each dimension as one of 2^bits levels that hold about as many rows each.

    Numbers take one pass for all dimensions, text is levelled by the order of whole values; what comes
    to the driver is 2^bits - 1 bounds for each. A null is the lowest value.
    """
    cuts = [i / 2**bits for i in range(1, 2**bits)]
    texts = [name for name in dims if isinstance(df.schema[name].dataType, T.StringType)]
    numbers = [F.percentile_approx(_value(df, n), cuts, 10_000).alias(f"b{i}") for i, n in enumerate(dims) if n not in texts]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *numbers).first()
    levels = []
    for i, name in enumerate(dims):
        if name in texts:
            bounds = _text_bounds(df, name, found["rows"], bits) if found["rows"] else []
        else:
            bounds = [float(b) for b in found[f"b{i}"] or []]
        kind = "array<string>" if name in texts else "array<double>"
        edges = F.array(*[F.lit(b) for b in bounds if b is not None]).cast(kind)
        nulls = sum(b is None for b in bounds)
        below = let(_value(df, name), lambda x, edges=edges: F.size(F.filter(edges, lambda b: F.coalesce(b <= x, F.lit(False)))))
        levels.append((below + nulls).cast("long"))
    return levels


def curve_index(levels: Sequence[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a point with ``bits``-bit coordinates.

    J. Skilling's transform ("Programming the Hilbert curve", 2004): undo the rotations from
    the highest bit down, Gray-encode, and read the bits of all coordinates in turn.
    """
    n = len(levels)
    name = "x{}".format
    point = F.struct(*[x.alias(name(i)) for i, x in enumerate(levels)])

    def struct(xs: Sequence[Column]) -> Column:
        return F.struct(*[x.alias(name(i)) for i, x in enumerate(xs)])

    def masks(last: int) -> Column:
        return F.array(*[F.lit(1 << q).cast("long") for q in range(bits - 1, last - 1, -1)]).cast("array<bigint>")

    def has(x: Column, mask: Column) -> Column:
        return x.bitwiseAND(mask) != 0

    def rotate(state: Column, mask: Column) -> Column:
        xs, low = [state[name(i)] for i in range(n)], mask - 1
        for i in range(n):
            swap = xs[0].bitwiseXOR(xs[i]).bitwiseAND(low)
            first = F.when(has(xs[i], mask), xs[0].bitwiseXOR(low)).otherwise(xs[0].bitwiseXOR(swap))
            if i:
                xs[i] = F.when(has(xs[i], mask), xs[i]).otherwise(xs[i].bitwiseXOR(swap))
            xs[0] = first
        return struct(xs)

    def gray(state: Column) -> Column:
        xs = [state[name(0)]]
        for i in range(1, n):
            xs.append(state[name(i)].bitwiseXOR(xs[-1]))
        return struct(xs)

    def flip(state: Column) -> Column:
        zero = F.lit(0).cast("long")
        turned = F.aggregate(
            masks(1), zero, lambda t, m: F.when(has(state[name(n - 1)], m), t.bitwiseXOR(m - 1)).otherwise(t)
        )
        return let(turned, lambda t: struct([state[name(i)].bitwiseXOR(t) for i in range(n)]))

    def interleave(state: Column) -> Column:
        def take(index: Column, mask: Column) -> Column:
            digits = [F.when(has(state[name(i)], mask), F.lit(1)).otherwise(F.lit(0)) for i in range(n)]
            return reduce(lambda total, digit: (total * 2 + digit).cast("long"), digits, index)

        return F.aggregate(masks(0), F.lit(0).cast("long"), take)

    turned = F.aggregate(masks(1), point, rotate) if bits > 1 else point
    return let(let(let(turned, gray), flip), interleave)


def hilbert_shards(
    docs: DataFrame,
    dims: Sequence[str] = ("lang", "source", "n_chars"),
    shards: int = 24,
    bits: int = 5,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Cut the rows, in curve order, into ``shards`` runs of counts at most one apart.

    Gives one row per row of ``docs``: the key, ``size`` (UTF-8 bytes plus 8), ``text_crc32``,
    ``curve_index``, ``shard`` and ``slot`` (0, 1, 2... in the shard). Each dimension is cut
    into 2^bits levels of about equal counts, so a level that holds a third of all rows spans
    many shards. Ties on the curve are ordered by text checksum and key, so copies lie together.
    Only these narrow columns are sorted; texts stay where they are (``write_shards`` moves them).

    Null text counts as empty, a null dimension as the lowest value, a null key sorts first.
    Repeated rows each have a slot. No rows in, no rows out. Other columns are not read.
    """
    levels = quantile_levels(docs, dims, bits)
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        curve_index(levels, bits).alias(_INDEX),
    )
    numbered = row_numbers(narrow, [F.col(_INDEX), F.col("text_crc32"), F.col(key)], out="_place")
    total = max(1, docs.count())
    shard = F.expr(f"cast(((_place - 1) * {shards}) div {total} as int)")
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    placed = numbered.withColumn("shard", shard)
    return placed.withColumn("slot", F.col("_place") - 1 - first).drop("_place")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", **options) -> None:
    """Write ``docs`` to ``path``, a folder per shard, each file sorted along the curve.

    Keys must be unique and not null. Rows of one shard go to one task each time, so choose the
    number of shards by the size a file should have.
    """
    shards = options.get("shards", 24)
    places = hilbert_shards(docs, key=key, **options).select(key, "shard", "slot")
    placed = docs.drop("shard", "slot").join(places, key)
    sorted_rows = placed.repartition(shards, "shard").sortWithinPartitions("shard", "slot")
    sorted_rows.write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars")
    return digest(hilbert_shards(docs))


def digest(shards: DataFrame) -> DataFrame:
    return shards.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        _INDEX,
    )
