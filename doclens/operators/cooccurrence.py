"""Word vectors that every run repeats: co-occurrence counts, their information, a randomised factorisation.

Sums over the cluster are sums of whole numbers, so they do not depend on the order or the number of
tasks; the factorisation needs no more of the driver than matrices of its own width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.operators.lookup import with_row_number
from doclens.session import written

# Fixed-point digits (bits) of information, of the orthonormal basis, of rows in a Gram matrix and of
# word vectors. With so many symbols at most, no sum passes 63 bits.
INFO_BITS, BASIS_BITS, GRAM_BITS, VECTOR_BITS = 16, 24, 20, 32
MAX_SYMBOLS = 1 << 20
# Numbers of a vector table that is sent to all tasks; larger ones are joined.
MAX_NUMBERS = 16_000_000


def cooccurrences(docs: DataFrame, window: int = 5, tokens: str = "tokens") -> DataFrame:
    """(a, b, n): how often ``b`` stands at most ``window`` places before or after ``a`` in a row.

    Symmetric; a pair of equal symbols counts from both sides. Places are exploded, not pairs held in
    the row, so a very long row needs no more memory than its tokens; pairs are counted once, in one
    direction, with partial sums before the shuffle. Null symbols and rows of under two tokens have no
    pairs; repeated rows count each time.
    """
    long_enough = docs.select(F.col(tokens).alias("_t")).filter(F.size("_t") > 1)
    places = long_enough.select("_t", F.explode(F.sequence(F.lit(0), F.size("_t") - 2)).alias("_i"))
    reached = places.select("_t", "_i", F.explode(F.array(*[F.lit(d) for d in range(1, window + 1)])).alias("_d"))
    reached = reached.filter(F.col("_i") + F.col("_d") < F.size("_t"))
    pairs = reached.select(F.get("_t", F.col("_i")).alias("x"), F.get("_t", F.col("_i") + F.col("_d")).alias("y")).dropna()
    counts = pairs.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count(F.lit(1)).alias("n"))

    def side(a: str, b: str, n: Column) -> Column:
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"), n.alias("n"))

    same = F.array(side("x", "y", F.col("n") * 2))
    both = F.when(F.col("x") == F.col("y"), same).otherwise(F.array(side("x", "y", F.col("n")), side("y", "x", F.col("n"))))
    return counts.select(F.inline(both))


def information(pairs: DataFrame) -> DataFrame:
    """Add ``info``: ln of n times all counts over the counts of ``a`` and of ``b``, 0 where that is less.

    Pass a written table, it is read more than once."""
    sums = pairs.groupBy("a").agg(F.sum("n").alias("_of_a"))
    total = sums.agg(F.sum("_of_a")).first()[0] or 0
    joined = pairs.join(sums, "a").join(sums.select(F.col("a").alias("b"), F.col("_of_a").alias("_of_b")), "b")
    ratio = F.col("n").cast("double") * total / (F.col("_of_a").cast("double") * F.col("_of_b"))
    return joined.select("a", "b", "n", F.greatest(F.lit(0.0), F.log(ratio)).alias("info"))


def _signs(symbol: Column, width: int, seed: int) -> Column:
    """``width`` signs, +1 or -1, that depend on the seed and the symbol alone."""
    hashes = [F.xxhash64(F.lit(seed), F.lit(word), symbol) for word in range(-(-width // 64))]
    bits = [F.shiftrightunsigned(hashes[j // 64], j % 64).bitwiseAND(F.lit(1).cast("bigint")) for j in range(width)]
    return F.array(*[bit * 2 - 1 for bit in bits])


def _times(matrix: DataFrame, basis: DataFrame, width: int) -> DataFrame:
    """(a, y): the matrix (a, b, w) times the basis (b, q), in whole numbers."""
    sums = [F.sum(F.col("w") * F.col("q")[j]).alias(f"s{j}") for j in range(width)]
    products = matrix.join(basis, "b").groupBy("a").agg(*sums)
    return written(products.select("a", F.array(*[f"s{j}" for j in range(width)]).alias("y")), "product")


def _gram(rows: DataFrame, width: int) -> tuple[np.ndarray, float]:
    """The Gram matrix of the columns of ``y``, exactly, after scaling to ``GRAM_BITS``; and the scale."""
    most = rows.agg(F.max(F.greatest(F.array_max("y"), -F.array_min("y")))).first()[0] or 1
    scale = 2.0**GRAM_BITS / most

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), np.int64)
        for batch in batches:
            y = np.rint(batch.column(0).flatten().to_numpy().reshape(-1, width) * scale).astype(np.int64)
            total += y.T @ y
        at = pa.array(np.arange(width * width, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([at, pa.array(total.ravel())], ["at", "value"])

    found = rows.select("y").mapInArrow(partial, "at int, value bigint").groupBy("at").agg(F.sum("value").alias("value"))
    gram = np.zeros(width * width)
    for row in found.collect():
        gram[row["at"]] = row["value"]
    return gram.reshape(width, width), scale


def _axes(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues that are not numerically 0, falling, and their vectors, the largest entry positive."""
    values, vectors = np.linalg.eigh(gram)
    kept = np.flatnonzero(values > 1e-12 * max(values.max(), 1e-300))[::-1]
    values, vectors = values[kept], vectors[:, kept]
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(kept))]
    return values, vectors * np.where(largest < 0, -1.0, 1.0)


def _mapped(rows: DataFrame, column: str, scale: float, turn: np.ndarray, bits: int | None) -> DataFrame:
    """Each row of ``column``, scaled, times ``turn``, under the same name, as whole numbers of ``bits``
    binary digits (rows rounded first, as for the Gram matrix), or as doubles. Summed in a fixed order."""
    wide = turn.shape[1]

    @F.arrow_udf("array<bigint>" if bits is not None else "array<double>")
    def map_(values: pa.Array) -> pa.Array:
        y = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, turn.shape[0]) * scale
        if bits is not None:
            y = np.rint(y)
        out = np.zeros((len(y), wide))
        for j in range(turn.shape[0]):
            out += y[:, j : j + 1] * turn[j]
        if bits is not None:
            out = np.rint(out * 2.0**bits).astype(np.int64)
        ends = pa.array(np.arange(len(y) + 1, dtype=np.int32) * wide)
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

    return rows.withColumn(column, map_(column))


def factorise(pairs: DataFrame, size: int = 64, rounds: int = 2, seed: int = 0, extra: int = 8) -> DataFrame:
    """(symbol, vec, context) from symmetric rows (a, b, info): the dot product of ``vec`` of one symbol and
    ``context`` of another is nearest to their information, among all tables of ``size`` columns.

    Randomised subspace iteration (Halko, Martinsson, Tropp, 2011): ``size + extra`` columns of hashed signs,
    multiplied by the matrix and made orthonormal ``rounds + 1`` times, then turned to the singular vectors;
    columns are scaled by the root of their singular values, which fall. A product is a join and sums
    by symbol with partial sums before the shuffle; what reaches the driver are Gram matrices.

    Products and Gram matrices are exact in fixed point, and rows are turned in a fixed order of operations,
    so the vectors have the same bits however the rows are cut into tasks. A matrix of lower rank gives
    fewer columns. Symbols without information have no row; more than ``MAX_SYMBOLS`` are a ``ValueError``,
    as the sums could pass 63 bits: cap the vocabulary.
    """
    weight = F.round(F.col("info") * 2**INFO_BITS).cast("bigint")
    matrix = written(pairs.select("a", "b", weight.alias("w")).filter("w > 0"), "information")
    symbols = matrix.select(F.col("a").alias("b")).distinct()
    held = symbols.count()
    if held > MAX_SYMBOLS:
        raise ValueError(f"more than {MAX_SYMBOLS} symbols")
    if not held:
        nothing = F.array().cast("array<double>")
        return symbols.select(F.col("b").alias("symbol"), nothing.alias("vec"), nothing.alias("context"))
    width = size + extra
    basis = symbols.select("b", _signs(F.col("b"), width, seed).alias("q"))
    for _ in range(rounds + 1):
        product = _times(matrix, basis, width)
        gram, scale = _gram(product, width)
        values, axes = _axes(gram)
        width = len(values)
        turned = _mapped(product, "y", scale, axes / np.sqrt(values), BASIS_BITS)
        basis = written(turned.select(F.col("a").alias("b"), F.col("y").alias("q")), "basis")
    product = _times(matrix, basis, width)
    gram, scale = _gram(product, width)
    values, axes = _axes(gram)
    unit = 2.0 ** -(INFO_BITS + BASIS_BITS)
    roots = np.sqrt(np.sqrt(values[:size]) / scale * unit)
    rows = product.join(basis.withColumnRenamed("b", "a"), "a")
    rows = _mapped(rows, "q", 2.0**-BASIS_BITS, axes[:, :size] * roots, None)
    rows = _mapped(rows, "y", unit, axes[:, :size] / roots, None)
    return written(rows.select(F.col("a").alias("symbol"), F.col("q").alias("vec"), F.col("y").alias("context")), "vectors")


def fit_vectors(
    docs: DataFrame, size: int = 64, window: int = 5, tokens: str = "tokens", rounds: int = 2, seed: int = 0
) -> DataFrame:
    """(symbol, vec, context) learnt from token arrays; see ``cooccurrences``, ``information``, ``factorise``.

    The symbols should be capped first (``dense.capped_tokens``, or ids of a capped vocabulary)."""
    pairs = written(cooccurrences(docs, window, tokens), "cooccurrences")
    return factorise(information(pairs), size, rounds, seed)


def mean_vectors(docs: DataFrame, vectors: DataFrame, tokens: str = "tokens", out: str = "vec") -> DataFrame:
    """Add the mean of the vectors of each row's tokens; a token without one counts as zeros, as does a row
    without tokens. Sums are whole numbers, so both ways give the same bits: tables of up to ``MAX_NUMBERS``
    numbers are broadcast and looked up in the row, larger ones joined by symbol, counted by row first."""
    first = vectors.select(F.size("vec").alias("n")).first()
    size = first["n"] if first else 0
    fixed = vectors.select("symbol", F.transform("vec", lambda x: F.round(x * 2.0**VECTOR_BITS).cast("bigint")).alias("_fixed"))
    divisor = F.greatest(F.size(tokens), F.lit(1)) * 2.0**VECTOR_BITS
    if vectors.count() * size <= MAX_NUMBERS:
        table = fixed.collect()
        kind = vectors.schema["symbol"].dataType
        names = pa.array([r["symbol"] for r in table], pa.string() if isinstance(kind, T.StringType) else pa.int64())
        numbers = np.array([r["_fixed"] for r in table], np.int64).reshape(len(table), size)
        sent = docs.sparkSession.sparkContext.broadcast((names, numbers))

        @F.arrow_udf("array<bigint>")
        def sums(rows: pa.Array) -> pa.Array:
            known, values = sent.value
            made = np.zeros((len(rows), size), np.int64)
            for at, row in enumerate(rows):
                held = row.values
                if held is not None and len(held):
                    found = pc.index_in(held.cast(known.type), value_set=known).drop_null().to_numpy()
                    used, times = np.unique(found, return_counts=True)
                    made[at] = times @ values[used]
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size)
            return pa.ListArray.from_arrays(ends, pa.array(made.ravel()))

        return docs.withColumn(out, F.transform(sums(F.col(tokens)), lambda x: x / divisor))
    numbered = with_row_number(docs, "_row")
    said = numbered.select("_row", F.explode(tokens).alias("symbol")).groupBy("_row", "symbol").agg(F.count(F.lit(1)).alias("_n"))
    sums_by_row = said.join(fixed, "symbol").groupBy("_row").agg(
        F.array(*[F.sum(F.col("_n") * F.col("_fixed")[j]) for j in range(size)]).alias("_sums")
    )
    zeros = F.array_repeat(F.lit(0).cast("bigint"), size)
    joined = numbered.join(sums_by_row, "_row", "left")
    mean = F.transform(F.coalesce("_sums", zeros), lambda x: x / divisor)
    return joined.withColumn(out, mean).drop("_row", "_sums")
