"""Term weighting: inverse corpus frequency and library-style tf-idf."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions import arrays
from doclens.operators.lookup import (
    bounded_rows,
    index_lookup,
    skew_safe_lookup,
    unnest,
    with_row_number,
)
from doclens.operators.numbering import row_numbers
from doclens.session import MAX_BROADCAST_ROWS, MAX_LITERAL_VALUES, written


def term_counts(docs: DataFrame, values: str = "ids", name: str = "id", key: str = "doc_id") -> DataFrame:
    """(doc, term, n), counted inside each row: no shuffle."""
    return unnest(docs, [key], arrays.run_lengths(F.col(values)), "_run").select(
        key, F.col("_run.value").alias(name), F.col("_run.n").alias("n")
    )


def corpus_counts(docs: DataFrame, values: str = "ids", name: str = "id") -> DataFrame:
    """(term, n) over the corpus."""
    return (
        unnest(docs, [], F.col(values), name).groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    )


def icf_weights(counts: DataFrame, name: str = "id") -> DataFrame:
    """(term, n, icf): ``ln(all symbols / count of the symbol)`` over the whole corpus."""
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(name, "n", F.log(total / F.col("n")).alias("icf"))


def term_freqs(docs: DataFrame, dims: int, values: str = "ids", name: str = "id") -> DataFrame:
    """(doc, term, tf): count divided by the number of vocabulary dimensions, not document length."""
    return term_counts(docs, values, name).withColumn("tf", F.col("n") / F.lit(float(dims)))


def icf_tfidf(
    docs: DataFrame,
    values: str = "ids",
    name: str = "id",
    counts: DataFrame | None = None,
    dims: int | None = None,
    key: str = "doc_id",
    max_terms: int | None = None,
) -> DataFrame:
    """(doc, term, weight): term frequency times inverse corpus frequency, as sparse rows.

    ``values`` may hold ids or symbols. ``counts`` are the corpus counts, taken from the
    documents when absent; a term without counts weighs 0. ``dims`` is the vocabulary
    size, the number of counted terms when absent. ``max_terms`` states the proven
    size of the vocabulary: up to the broadcast limit the weights are broadcast,
    otherwise only those of terms that are frequent among the rows are.
    """
    broadcast = max_terms is not None and max_terms <= MAX_BROADCAST_ROWS
    runs = docs.select(key, arrays.run_lengths(F.col(values)).alias("_runs"))
    if counts is None or not broadcast:
        # Counted in the row once: the corpus counts and the lookups below read the runs.
        runs = written(runs, "runs")
    freqs = unnest(runs, [key], F.col("_runs"), "_run").select(
        key, F.col("_run.value").alias(name), F.col("_run.n").alias("n")
    )
    if counts is None:
        # Read more than once below; one vocabulary-sized table instead of several corpus passes.
        counts = written(freqs.groupBy(name).agg(F.sum("n").alias("n")), "counts")
    weights = icf_weights(counts, name)
    size = F.lit(float(dims)) if dims else counts.agg(F.count(F.lit(1)).cast("double")).scalar()
    table = weights.select(name, "icf")
    if broadcast:
        joined = freqs.join(F.broadcast(table), name, "left")
    else:
        joined = skew_safe_lookup(freqs, table, name)
    return joined.select(
        key, name, (F.col("n") / size * F.coalesce("icf", F.lit(0.0))).alias("weight")
    )


def top_icf_terms(
    docs: DataFrame, vocab: DataFrame, limit: int = 10, digits: int = 9, values: str = "ids", key: str = "doc_id"
) -> DataFrame:
    """(key, symbol, weight, rn): ``icf_tfidf`` and ``top_terms`` in one, over a vocabulary of at most
    ``MAX_LITERAL_VALUES`` symbols. Weights are looked up and ranked inside the row, so nothing but the
    corpus counts is shuffled."""
    counts = written(corpus_counts(docs, values), "counts")
    rows = bounded_rows(icf_weights(counts).join(vocab.select("id", "symbol"), "id"), MAX_LITERAL_VALUES)
    if rows is None:
        names = vocab.select("id", "symbol")
        return top_terms(icf_tfidf(docs, values, counts=counts, key=key).join(names, "id").drop("id"), "symbol", limit, key, digits)
    size, last = float(counts.count()), max((r["id"] for r in rows), default=-1)
    weight, symbol = {r["id"]: r["icf"] for r in rows}, {r["id"]: r["symbol"] for r in rows}
    icf = arrays.literal_array([weight.get(i) for i in range(last + 1)], "array<double>")
    names = arrays.literal_array([symbol.get(i) for i in range(last + 1)], "array<string>")
    ranked = F.array_sort(
        F.transform(
            arrays.run_lengths(F.col(values)),
            lambda run: F.struct(
                (-F.round(run["n"] / F.lit(size) * F.get(icf, run["value"]), digits)).alias("minus"),
                F.get(names, run["value"]).alias("symbol"),
            ),
        )
    )
    best = F.filter(ranked, lambda t: t["symbol"].isNotNull())
    return docs.select(key, F.posexplode(F.slice(best, 1, limit)).alias("_place", "_term")).select(
        key, "_term.symbol", (-F.col("_term.minus")).alias("weight"), (F.col("_place") + 1).cast("long").alias("rn")
    )


def top_terms(weighted: DataFrame, name: str, limit: int = 10, key: str = "doc_id", digits: int = 9) -> DataFrame:
    """The heaviest terms of each document. A document is one row's worth, so its window is small."""
    rounded = weighted.withColumn("weight", F.round("weight", digits))
    order = Window.partitionBy(key).orderBy(F.col("weight").desc(), F.col(name))
    return rounded.withColumn("rn", F.row_number().over(order).cast("long")).filter(
        F.col("rn") <= limit
    )


@dataclass
class TfidfModel:
    """Fitted terms (term, idx, df, n, idf), their number bounded by ``max_features``."""

    terms: DataFrame
    rows: list | None
    in_row: int = MAX_LITERAL_VALUES

    def transform(self, docs: DataFrame, values: str = "terms", out: str = "weights", key: str = "doc_id") -> DataFrame:
        """Add ``array<struct<idx, weight>>``, l2-normalised; terms not fitted are dropped.

        Up to ``in_row`` terms are looked up in the row, more are joined; the rows are the same."""
        if self.rows is None or len(self.rows) > self.in_row:
            return self._transform_by_join(docs, values, out)
        if not self.rows:
            empty = F.array().cast("array<struct<idx:int,weight:double>>")
            return docs.withColumn(out, empty)
        lookup = index_lookup(
            docs.sparkSession, [r["term"] for r in self.rows], [r["idx"] for r in self.rows], -1
        )
        idf = arrays.literal_array([r["idf"] for r in self.rows], "array<double>")
        known = F.filter("_idx", lambda i: i >= 0)
        weighted = arrays.let(
            known,
            lambda ids: F.transform(
                arrays.run_lengths(ids),
                lambda run: F.struct(
                    run["value"].alias("idx"), (run["n"] * F.get(idf, run["value"])).alias("weight")
                ),
            ),
        )
        return docs.withColumn("_idx", lookup(F.col(values))).withColumn(out, _unit(weighted)).drop("_idx")

    def _transform_by_join(self, docs: DataFrame, values: str, out: str) -> DataFrame:
        docs, key = with_row_number(docs, "_row"), "_row"
        counted = term_counts(docs, values, "term", key).withColumnRenamed("n", "_tf")
        found = skew_safe_lookup(counted, self.terms, "term").filter(F.col("idx").isNotNull())
        raw = found.groupBy(key).agg(
            F.array_sort(
                F.collect_list(
                    F.struct("idx", (F.col("_tf") * F.col("idf")).alias("weight"))
                )
            ).alias("_raw")
        )
        scaled = raw.select(key, _unit(F.col("_raw")).alias(out))
        empty = F.array().cast("array<struct<idx:int,weight:double>>")
        return docs.join(scaled, key, "left").withColumn(out, F.coalesce(out, empty)).drop(key)

    def dense_rows(self, docs: DataFrame, values: str = "terms", key: str = "doc_id") -> list[list[float]]:
        """The vectors of a few documents, in the order of ``key``, as starting centroids."""
        width = len(self.rows or [])
        rows = self.transform(docs, values, "_weights").select(key, "_weights").orderBy(key).collect()
        table = [[0.0] * width for _ in rows]
        for dense, row in zip(table, rows, strict=True):
            for entry in row["_weights"]:
                dense[entry["idx"]] = entry["weight"]
        return table

    def exploded(self, docs: DataFrame, values: str = "terms", key: str = "doc_id") -> DataFrame:
        """(doc, idx, weight) rows."""
        return self.transform(docs, values, "_weights", key).select(
            key, F.inline("_weights")
        )

    def to_ml(self, values: str = "terms", out: str = "features") -> PipelineModel:
        """The same weights as ML stages giving sparse vectors, for the ML estimators.

        Without terms the vectors have one place, always 0. The estimators hold dense rows of this
        width on the driver, so more terms than can be broadcast are refused: lower ``max_features``.
        """
        if self.rows is None:
            raise ValueError(f"ML vectors are limited to {MAX_BROADCAST_ROWS} terms: lower max_features")
        terms = [r["term"] for r in self.rows] or ["\u0000"]
        counter = CountVectorizerModel.from_vocabulary(terms, inputCol=values, outputCol="_counts")
        scale = ElementwiseProduct(
            scalingVec=Vectors.dense([r["idf"] for r in self.rows] or [0.0]),
            inputCol="_counts",
            outputCol="_scaled",
        )
        norm = Normalizer(p=2.0, inputCol="_scaled", outputCol=out)
        return PipelineModel([counter, scale, norm])


def _unit(weights: Column) -> Column:
    """Sparse weights divided by their l2 norm."""

    def scaled(raw: Column, norm: Column) -> Column:
        return F.transform(
            raw, lambda w: F.struct(w["idx"].alias("idx"), (w["weight"] / norm).alias("weight"))
        )

    def norm(raw: Column) -> Column:
        return F.sqrt(
            F.aggregate(raw, F.lit(0.0), lambda total, w: total + w["weight"] * w["weight"])
        )

    return arrays.let(weights, lambda raw: arrays.let(norm(raw), lambda n: scaled(raw, n)))


def document_frequencies(docs: DataFrame, values: str = "terms") -> DataFrame:
    """(term, df, n): documents holding the term, and its corpus count, in one pass.

    A row's terms are followed by its different terms once more, and the place tells which of both an
    element is. Generated code does all of it; ``run_lengths`` evaluates a lambda for every term."""
    terms = F.col(values)
    places = F.posexplode_outer(F.concat(terms, F.array_distinct(terms))).alias("_pos", "term")
    again = F.col("_pos") >= F.col("_size")
    return (
        docs.select(F.size(terms).alias("_size"), places)
        .filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count_if(again).alias("df"), F.count_if(~again).alias("n"))
    )


def fit_tfidf(
    train: DataFrame,
    values: str = "terms",
    max_features: int | None = 20_000,
    min_df: int = 2,
    max_df: float = 0.5,
    stop_words: DataFrame | None = None,
    idf: str = "smooth_plus_one",
) -> TfidfModel:
    """Pick the terms and weights from training documents.

    Keeps terms found in at least ``min_df`` documents and at most the share
    ``max_df`` of them, then the ``max_features`` most frequent, ties by term.
    ``stop_words`` is a (term) table. ``idf`` is ``smooth_plus_one`` for
    ``ln((1+N)/(1+df)) + 1`` or ``smooth`` without the added 1.
    """
    n_docs = train.count()
    table = document_frequencies(train, values)
    table = table.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if stop_words is not None:
        table = table.join(stop_words.select("term"), "term", "left_anti")
    bounded = max_features is not None and max_features <= MAX_BROADCAST_ROWS
    order = [F.col("n").desc(), F.col("term")]
    if bounded:
        table = table.orderBy(*order).limit(max_features)
    elif max_features is not None:
        table = row_numbers(table, order, out="_rank").filter(F.col("_rank") <= max_features).drop("_rank")
    added = {"smooth_plus_one": 1.0, "smooth": 0.0}[idf]
    table = table.withColumn(
        "idf", F.log(F.lit(1.0 + n_docs) / (F.lit(1.0) + F.col("df"))) + added
    )
    if bounded:
        place = F.row_number().over(Window.orderBy("term")) - 1
        numbered = table.withColumn("idx", place.cast("int"))
    else:
        numbered = row_numbers(table, [F.col("term")], out="idx")
        numbered = numbered.withColumn("idx", (F.col("idx") - 1).cast("int"))
    numbered = written(numbered.select("term", "idx", "df", "n", "idf"), "terms")
    return TfidfModel(numbered, bounded_rows(numbered.orderBy("idx")))
