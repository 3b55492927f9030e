"""Sparse rows: dot products, silhouettes and k-means over any number of terms.

A row is ``array<struct<idx, weight>>`` as ``TfidfModel.transform`` gives it. What rows are compared with,
a sample or centroids, is an inverted index: its entries (idx, item, value) sorted by term and stored in
blocks (``blockfile``). A task reads the blocks of its rows' terms, so neither the driver nor an executor
holds a row, a centroid or the index at full width.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.functions import sampling
from doclens.operators.blockfile import BLOCK, BlockFile, Reader, write_blocks
from doclens.operators.lookup import bounded_rows, with_row_number
from doclens.session import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Items an index may have: a task holds one number per row and item. Rows x items worked on at a time.
MAX_ITEMS, CELLS = 20_000, 1 << 20
# Squared distances below this share of the squared lengths are rounding, and 0.
_SAME = 1e-12


def entries(rows: DataFrame, item: str, weights: str = "weights") -> DataFrame:
    """(item, idx, value) of sparse rows."""
    return rows.select(F.col(item).cast("bigint").alias("item"), F.inline(weights)).select(
        "item", F.col("idx").cast("bigint").alias("idx"), F.col("weight").alias("value")
    )


def inverted_index(table: DataFrame, block: int = BLOCK) -> BlockFile:
    """(item, idx, value) entries stored by term."""
    return write_blocks(table.select("idx", "item", "value"), "idx", block)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of each entry of some sparse rows, in order of the terms."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    flat = lists.flatten()
    idx = np.asarray(flat.field("idx"), np.int64)
    order = np.argsort(idx, kind="stable")
    return np.repeat(np.arange(len(lists)), sizes)[order], idx[order], np.asarray(flat.field("weight"), np.float64)[order]


def dot_products(reader: Reader, row: np.ndarray, idx: np.ndarray, weight: np.ndarray, rows: int, items: int) -> np.ndarray:
    """Rows by items, from entries in order of the terms. Each sum goes by blocks and terms, so it does not
    depend on which rows are worked on together."""
    dots = np.zeros(rows * items)
    for block, start, stop in reader.parts(idx.tolist()) if len(reader.table.firsts) else ():
        known = reader.block(block)
        terms, item, value = (known.column(n).to_numpy() for n in ("idx", "item", "value"))
        left = np.searchsorted(terms, idx[start:stop], "left")
        count = np.searchsorted(terms, idx[start:stop], "right") - left
        entry = np.repeat(np.arange(start, stop), count)
        place = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(left, count)
        cells = row[entry] * items + item[place]
        dots += np.bincount(cells, weight[entry] * value[place], minlength=rows * items)
    return dots.reshape(rows, items)


def _by_chunk(reader: Reader, lists: pa.Array, items: int):
    """(start, dots, squared lengths) of some rows at a time."""
    step = max(1, CELLS // max(1, items))
    for start in range(0, len(lists), step):
        part = lists.slice(start, step)
        row, idx, weight = _flat(part)
        own = np.bincount(row, weight * weight, minlength=len(part))
        yield start, dot_products(reader, row, idx, weight, len(part), items), own


def _distances(dots: np.ndarray, own: np.ndarray, squares: np.ndarray) -> np.ndarray:
    sums = own[:, None] + squares[None, :]
    gaps = sums - 2.0 * dots
    return np.sqrt(np.where(gaps > _SAME * sums, gaps, 0.0))


# --- silhouette ---


def silhouettes(
    sample: DataFrame, weights: str = "weights", cluster: str = "cluster", limit: int = MAX_ITEMS, block: int = BLOCK
) -> DataFrame:
    """Add ``silhouette`` (euclidean) to each sparse row of a sample of at most ``limit`` rows, whatever
    their width; null for null weights or a null cluster.

    Distances are lengths and dot products with the sample, read from its inverted index. The driver has
    a cluster and a length for each row of the sample, no weights.
    """
    rows = with_row_number(sample, "_row")
    known = rows.filter(F.col(weights).isNotNull() & F.col(cluster).isNotNull())
    square = F.aggregate(weights, F.lit(0.0), lambda total, w: total + w["weight"] * w["weight"])
    listed = bounded_rows(known.select("_row", F.col(cluster).alias("c"), square.alias("s")), limit)
    if listed is None:
        raise ValueError(f"a silhouette compares every two rows: draw a sample of at most {limit}")
    if not listed:
        return sample.withColumn("silhouette", F.lit(None).cast("double"))
    listed.sort(key=lambda r: r["_row"])
    # The numbers of the sample's rows, in order, are the items.
    numbers = np.array([r["_row"] for r in listed])
    names, codes = np.unique([r["c"] for r in listed], return_inverse=True)
    squares, sizes = np.array([r["s"] for r in listed]), np.bincount(codes)
    spark = sample.sparkSession
    numbered = spark.createDataFrame([(int(n), i) for i, n in enumerate(numbers)], "_row long, _item long")
    table = inverted_index(entries(known.join(F.broadcast(numbered), "_row"), "_item", weights), block)

    @F.arrow_udf("double")
    def score(lists: pa.Array, clusters: pa.Array) -> pa.Array:
        out = np.full(len(lists), np.nan)
        valid = np.flatnonzero(np.asarray(pc.and_(lists.is_valid(), clusters.is_valid())))
        if not len(valid):
            return pa.nulls(len(lists), pa.float64())
        own_cluster = np.searchsorted(names, np.asarray(clusters.take(pa.array(valid))))
        for start, dots, own in _by_chunk(table.reader(), lists.take(pa.array(valid)), len(codes)):
            gaps = _distances(dots, own, squares)
            mine = own_cluster[start : start + len(own)]
            totals = np.stack([gaps[:, codes == c].sum(axis=1) for c in range(len(names))], axis=1)
            here = np.arange(len(own))
            inner = totals[here, mine] / np.maximum(sizes[mine] - 1, 1)
            means = totals / sizes
            means[here, mine] = np.inf
            outer = means.min(axis=1)
            largest = np.maximum(inner, outer)
            alone = (sizes[mine] < 2) | (len(names) < 2) | (largest <= 0)
            with np.errstate(invalid="ignore", divide="ignore"):
                out[valid[start : start + len(own)]] = np.where(alone, 0.0, (outer - inner) / largest)
        return pa.array(out, from_pandas=True)

    return rows.drop("_row").withColumn("silhouette", score(F.col(weights), F.col(cluster)))


# --- k-means ---


@dataclass
class SparseKMeans:
    """Centroids as (item, idx, value), their squared lengths, and their index by term."""

    centroids: DataFrame
    squares: list[float]
    index: BlockFile
    rounds: int
    converged: bool

    def predict(self, rows: DataFrame, weights: str = "weights", out: str = "cluster") -> DataFrame:
        """Add the nearest centroid, the lowest number on ties; null for null weights."""
        return rows.withColumn(out, nearest_item(self.index, self.squares)(F.col(weights)))


def nearest_item(index: BlockFile, squares: list[float], digits: int = 9):
    """``array<struct<idx, weight>> -> int``: the nearest item by euclidean distance rounded to ``digits``."""
    lengths = np.asarray(squares)

    @F.arrow_udf("int")
    def nearest(lists: pa.Array) -> pa.Array:
        found = np.zeros(len(lists), np.int32)
        for start, dots, own in _by_chunk(index.reader(), lists, len(lengths)):
            found[start : start + len(own)] = np.round(_distances(dots, own, lengths), digits).argmin(axis=1)
        return pa.array(found, mask=np.asarray(lists.is_null()))

    return nearest


def nearest_by_terms(terms: BlockFile, index: BlockFile, squares: list[float], digits: int = 9):
    """``array<string> -> int``: the item nearest to a row's tf-idf vector, counts of the terms in the file
    (term, idf, idx) times their idf, scaled to length 1. A row without any has the zero vector."""
    lengths = np.asarray(squares)

    @F.arrow_udf("int")
    def nearest(tokens: pa.Array) -> pa.Array:
        flat = tokens.flatten().dictionary_encode()
        reader, centroids = terms.reader(), index.reader()
        idx = reader.values(flat.dictionary, "idx")
        known = np.asarray(idx.is_valid())
        places = np.asarray(pc.fill_null(idx.cast(pa.int64()), -1))
        idf = np.asarray(pc.fill_null(reader.values(flat.dictionary, "idf").cast(pa.float64()), 0.0))
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
        ends = np.r_[0, np.cumsum(sizes)]
        codes = flat.indices.to_numpy()
        # Distinct terms are numbered in the order of their idx, so that counted cells are sorted as well.
        order = np.argsort(places, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        found = np.empty(len(tokens), np.int32)
        step = max(1, CELLS // max(1, len(lengths)))
        for start in range(0, len(tokens), step):
            stop = min(len(tokens), start + step)
            part = codes[ends[start] : ends[stop]]
            row = np.repeat(np.arange(stop - start), sizes[start:stop])
            keep = known[part]
            cells, times = np.unique(rank[part[keep]] * (stop - start) + row[keep], return_counts=True)
            term, row = order[cells // (stop - start)], cells % (stop - start)
            weight = times * idf[term]
            norm = np.sqrt(np.bincount(row, weight * weight, minlength=stop - start))
            weight = weight / norm[row]
            own = np.bincount(row, weight * weight, minlength=stop - start)
            dots = dot_products(centroids, row, places[term], weight, stop - start, len(lengths))
            found[start:stop] = np.round(_distances(dots, own, lengths), digits).argmin(axis=1)
        return pa.array(found)

    return nearest


def index_of(centroids: DataFrame, k: int, block: int = BLOCK) -> tuple[BlockFile, list[float]]:
    """The inverted index of (item, idx, value) centroids 0 to k - 1, and their squared lengths."""
    if k > MAX_ITEMS:
        raise ValueError(f"{k} centroids, a task compares with at most {MAX_ITEMS}")
    squares = [0.0] * k
    for row in centroids.groupBy("item").agg(_exact_sum(F.col("value") * F.col("value")).alias("s")).collect():  # k rows
        squares[row["item"]] = float(row["s"])
    return inverted_index(centroids, block), squares


def _exact_sum(value):
    """A sum that is the same for any order of rows: parts below 1e-20 are cut off first."""
    return F.sum(value.cast("decimal(38,20)"))


def seeded_rows(rows: DataFrame, k: int, seed: int = 0, id_col: str = "doc_id", weights: str = "weights") -> DataFrame:
    """(item, idx, value) of k rows drawn by a seeded hash, rows without any weight last."""
    order = [F.size(weights) == 0, sampling.hash_hex(seed, F.col(id_col)), F.col(id_col)]
    picked = rows.filter(F.col(weights).isNotNull()).select(id_col, *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    ids = [row[id_col] for row in picked.orderBy("_o0", "_o1", "_o2").limit(k).collect()]  # k ids
    items = F.array_position(F.array(*map(F.lit, ids)), F.col(id_col)) - 1
    drawn = rows.filter(F.col(id_col).isin(ids) & F.col(weights).isNotNull()).dropDuplicates([id_col])
    return entries(drawn.withColumn("_item", items), "_item", weights)


def sparse_kmeans(
    rows: DataFrame, k: int, max_iters: int = 100, seed: int = 0, id_col: str = "doc_id", weights: str = "weights",
    initial: DataFrame | None = None, block: int = BLOCK,
) -> SparseKMeans:
    """Lloyd's k-means over sparse rows of any width, until no row changes its cluster.

    ``initial`` has (item, idx, value) centroids 0 to k - 1; without it ``seeded_rows``. Centroids are
    sparse, whole and stored by term. A round assigns rows where they are, sums (cluster, term) with
    partial sums before the shuffle, and sends k squared lengths to the driver. Sums are exact decimals
    (weights of up to 1e10, to 20 places), so the result does not depend on the number of partitions.
    An empty cluster keeps its centroid. Null weights are in no cluster.
    """
    known = rows.filter(F.col(weights).isNotNull()).select(id_col, weights)
    centroids = written(initial if initial is not None else seeded_rows(known, k, seed, id_col, weights), "centroids")
    before = None
    for number in range(max_iters + 1):
        index, squares = index_of(centroids, k, block)
        model = SparseKMeans(centroids, squares, index, number, False)
        assigned = written(model.predict(known, weights).select("cluster", id_col, weights), "assigned")
        mark = assigned.agg(F.sum(F.xxhash64(id_col, "cluster").cast("decimal(38,0)"))).first()[0]
        if mark == before or number == max_iters:
            model.converged = mark == before
            return model
        before = mark
        sizes = assigned.groupBy(F.col("cluster").cast("bigint").alias("item")).agg(F.count(F.lit(1)).alias("n"))
        sums = entries(assigned, "cluster", weights).groupBy("item", "idx").agg(_exact_sum(F.col("value")).alias("total"))
        means = sums.join(F.broadcast(sizes), "item").select("item", "idx", (F.col("total").cast("double") / F.col("n")).alias("value"))
        kept = centroids.join(F.broadcast(sizes), "item", "left_anti")
        centroids = written(means.unionByName(kept), "centroids")
    raise AssertionError("unreachable")
