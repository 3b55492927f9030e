"""Mix sources to target weights: temperature, then whole seeded passes cut at a token budget."""

from __future__ import annotations

from math import ceil, log, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.llm.common import let, read

# Sources whose sums and weights the driver holds and sends to all tasks.
MAX_SOURCES = 1_000_000


def slice_bits(spark: SparkSession) -> int:
    """Leading bits of the order's hash that cut a permutation: eight slices or more for each shuffle
    partition. Slices follow the order, so their number does not change it."""
    return max(8, ceil(log2(8 * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def token_count(text: Column) -> Column:
    """Words between white space, null counts none."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"\s+")
    # an empty piece before leading, or after trailing, white space is no word
    first = lambda p: F.when(p[0] == "", 1).otherwise(0)
    last = lambda p: F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0)
    return let(pieces, lambda p: F.size(p) - first(p) - last(p)).cast("long")


def weights(tokens: dict, exponent: float) -> dict:
    """Shares raised to ``exponent``, normalised; a source without tokens weighs nothing."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()} if total else {}
    scale = sum(raw.values())
    return {s: (raw[s] / scale if scale else 0.0) for s in tokens}


def entropy(shares: dict) -> float:
    return -sum(w * log(w) for w in shares.values() if w > 0)


def passes(tokens: dict, shares: dict, budget: float) -> float:
    """Most often any source is repeated when ``budget`` tokens are drawn."""
    return max((shares[s] * budget / n for s, n in tokens.items() if n), default=0.0)


def full_budget(tokens: dict, shares: dict) -> float:
    """The least budget that draws every source at least once in full."""
    return max((n / shares[s] for s, n in tokens.items() if n and shares[s] > 0), default=0.0)


def solve_exponent(tokens: dict, target: float, limit: float, budget: float | None) -> float:
    """The exponent nearest to 1, down to 0, at which the entropy reaches ``target`` times that of
    equal weights, unless some source would be repeated more than ``limit`` times: then the exponent
    at which it is repeated that often. Bisection; entropy falls and repetition falls as it grows."""
    even = log(sum(1 for n in tokens.values() if n) or 1)

    def spent(a: float) -> float:
        w = weights(tokens, a)
        return passes(tokens, w, budget if budget is not None else full_budget(tokens, w))

    def bisect(too_low) -> float:
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if too_low(middle) else (low, middle)
        return (low + high) / 2

    wanted = 1.0 if entropy(weights(tokens, 1.0)) >= target * even else bisect(
        lambda a: entropy(weights(tokens, a)) > target * even
    )
    if spent(wanted) <= limit or spent(1.0) >= limit:
        return wanted if spent(wanted) <= limit else 1.0
    return bisect(lambda a: spent(a) > limit)


def _drawn(
    docs: DataFrame,
    target: float,
    limit: float,
    budget: int | None,
    seed: int,
    key: str,
    source: str,
    text: str,
    places: bool,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The draws, under names of their own: ``_key``, ``_source``, ``_tokens``, ``_block``, ``_place``,
    ``_weight`` and ``_row``, which holds the carried columns. See ``mix``; without ``places`` the rows
    of whole blocks are not shuffled and have none."""
    spark = docs.sparkSession
    row = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select(
        F.col(key).alias("_key"), F.col(source).alias("_source"), token_count(F.col(text)).alias("_tokens"), row.alias("_row")
    )
    sums = rows.groupBy("_source").agg(F.sum("_tokens").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources; mix by a coarser column")
    tokens = {r[0]: r["n"] or 0 for r in sums}
    held = sum(tokens.values())
    if budget is not None and held and budget > limit * held:
        raise ValueError(f"a budget of {budget} tokens repeats the {held} there are more than {limit} times")
    shares = weights(tokens, solve_exponent(tokens, target, limit, budget))
    total = budget if budget is not None else full_budget(tokens, shares)
    plan = [
        (s, float(shares[s]), int(round(shares[s] * total)), n, max(1, -(-int(round(shares[s] * total)) // n)) if n else 1)
        for s, n in tokens.items()
    ]
    kind = rows.schema["_source"].dataType.simpleString()
    table = spark.createDataFrame(plan, f"_from {kind}, _weight double, _budget bigint, _n bigint, _blocks int")
    # one row per source, MAX_SOURCES at most
    planned = rows.join(F.broadcast(table), F.col("_source").eqNullSafe(F.col("_from"))).drop("_from")
    drawn = planned.withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    order = F.xxhash64(F.lit(seed), F.col("_block"), F.col("_key"), F.col("_source"))
    dealt = drawn.withColumn("_order", order).withColumn(
        "_slice", F.shiftrightunsigned("_order", 64 - slice_bits(spark))
    )
    cut = ((F.col("_block") + 1) * F.col("_n") > F.col("_budget")) & (F.col("_n") > 0)
    permuted = dealt if places else dealt.filter(cut)
    where = ["_group", "_block", "_slice"]
    group = F.coalesce(F.concat(F.lit("s"), F.col("_source").cast("string")), F.lit("null"))
    permuted = permuted.withColumn("_group", group)
    slices = permuted.groupBy(*where).agg(F.sum("_tokens").alias("_sum"))
    earlier = Window.partitionBy("_group", "_block").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = slices.select(*where, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*where).orderBy("_order", "_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        permuted.withColumn("_inside", F.coalesce(F.sum("_tokens").over(inside), F.lit(0)))
        .join(before, where)
        .withColumn("_place", F.col("_inside") + F.col("_before"))
        .filter(~cut | (F.col("_place") + F.col("_block") * F.col("_n") < F.col("_budget")))
    )
    columns = ["_key", "_source", "_tokens", F.col("_block").cast("int").alias("_block"), "_place", "_weight", "_row"]
    if places:
        return placed.select(*columns)
    whole = dealt.filter(~cut).withColumn("_place", F.lit(None).cast("bigint"))
    return whole.select(*columns).unionByName(placed.select(*columns))


def mix(
    docs: DataFrame,
    target: float = 0.95,
    limit: float = 4.0,
    budget: int | None = None,
    seed: int = 17,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The drawn rows: key, source, ``tokens``, ``block``, ``place`` and ``weight``.

    A source's weight is its token share to the power found by ``solve_exponent``; its budget is its
    weight times ``budget`` tokens, by default the least total at which every source is drawn once in
    full, so that mixing repeats small sources and loses nothing. A block is one pass over a source
    in a seeded permutation of its own; blocks follow each other until the source's budget is met, and the
    row that meets it is the last. ``place`` is the running token count before the row in its block:
    rows of a source, by block, then place, are its training order.

    Only sums per source and slice, no rows, reach the driver or a single task: the permutations are cut into
    slices by the leading bits of the hash, in proportion to the shuffle partitions, so a source with a
    third of all rows is dealt to many tasks. Tokens are counted once, in the first pass; the second recounts them in the row.

    A null source is a source. A row without tokens costs nothing: it is drawn in each block that
    reaches its place. A source without tokens is drawn once, whole. Repeated rows have their own
    places, equal ones if they have no tokens; equal hashes are ordered by key. Empty in, empty out.
    Other columns are not read. A ``budget`` that would repeat even the corpus as it is more than
    ``limit`` times, and more than ``MAX_SOURCES`` sources, are a ``ValueError``.
    """
    drawn = _drawn(docs, target, limit, budget, seed, key, source, text, places=True)
    named = {key: "_key", source: "_source", **{c: f"_{c}" for c in ("tokens", "block", "place", "weight")}}
    return drawn.select(*[F.col(own).alias(name) for name, own in named.items()])


def mixed_documents(
    docs: DataFrame,
    target: float = 0.95,
    limit: float = 4.0,
    budget: int | None = None,
    seed: int = 17,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The drawn documents, one row per draw, with the columns of ``docs``, whatever their names; the
    draws of ``mix``. A table has no order, so whole blocks need no places here and are not shuffled."""
    drawn = _drawn(docs, target, limit, budget, seed, key, source, text, places=False, carry=tuple(docs.columns))
    return drawn.select("_row.*")


def query(spark: SparkSession, sf: str) -> DataFrame:
    return mix(read(spark, sf, "documents", "doc_id", "source", "text"))
