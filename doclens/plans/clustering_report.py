"""Vectorise, cluster, score: the main job, for one clustering or several compared."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import KMeansModel
from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions.text import joined, word_terms
from doclens.operators import cooccurrence, evaluation, sparse
from doclens.operators.clustering import choose_k, kmeans_fit
from doclens.operators.dense import capped_tokens, embed_documents, fit_embedding
from doclens.operators.lengths import filter_length
from doclens.operators.sparse import SparseKMeans
from doclens.operators.vocab import build_vocab, short_documents, split_train_test, symbol_counts, with_tokens
from doclens.operators.weights import fit_tfidf
from doclens.session import written


@dataclass
class Report:
    """Scores of one clustering. ``train`` and ``test`` hold doc_id, cluster, topics."""

    model: KMeansModel | SparseKMeans
    train: DataFrame
    test: DataFrame
    top_labels: DataFrame
    scores: DataFrame


def prepare(docs: DataFrame, max_len: int | None = 200) -> DataFrame:
    """(doc_id, split, topics, tokens, terms), short documents only, tokenised once and written.

    ``left_out`` tells how many documents were too long."""
    if "tokens" not in docs.columns:
        tokens = short_documents(docs, max_len) if max_len else with_tokens(docs)
    else:
        tokens = filter_length(docs, max_len) if max_len else docs
    kept = tokens.select("doc_id", "split", "topics", "tokens")
    return written(kept.withColumn("terms", word_terms(joined(F.col("tokens")))), "prepared")


def left_out(docs: DataFrame, prepared: DataFrame) -> DataFrame:
    """(n_docs, n_kept, n_left_out): documents that ``prepare`` left out by length."""
    kept = F.lit(prepared.count())
    return docs.agg(F.count(F.lit(1)).alias("n_docs")).select(
        "n_docs", kept.alias("n_kept"), (F.col("n_docs") - kept).alias("n_left_out")
    )


def english_stop_words(spark: SparkSession) -> DataFrame:
    """(term): the English stop words that Spark ships."""
    words = sorted({word.lower() for word in StopWordsRemover.loadDefaultStopWords("english")})
    return spark.createDataFrame([(word,) for word in words], "term string")


def tfidf_features(
    docs: DataFrame, max_features: int = 20_000, stop_words: DataFrame | None = None
) -> DataFrame:
    """Add sparse ``features``, fitted on the training split."""
    train, _ = split_train_test(docs)
    model = fit_tfidf(train, max_features=max_features, stop_words=stop_words).to_ml()
    return model.transform(docs).drop("_counts", "_scaled")


def dense_features(
    docs: DataFrame, size: int = 64, most_common: int = 20_000, seed: int = 0, repeatable: bool = False
) -> DataFrame:
    """Add dense ``features``: mean word vectors learnt from the training split, by the library's Word2Vec
    or, ``repeatable``, by ``cooccurrence.fit_vectors``, which gives every run the same bits."""
    vocab = written(build_vocab(symbol_counts(docs), most_common=most_common), "vocab")
    capped = written(capped_tokens(docs, vocab), "capped")
    train, _ = split_train_test(capped)
    if repeatable:
        vectors = cooccurrence.fit_vectors(train, size, seed=seed)
        return cooccurrence.mean_vectors(capped, vectors).withColumn("features", array_to_vector("vec")).drop("vec")
    embedded = embed_documents(capped, fit_embedding(train, size, seed=seed))
    return embedded.withColumn("features", array_to_vector("vec")).drop("vec")


def report(featured: DataFrame, k: int = 0, seed: int = 0) -> Report:
    """Fit on the training split, then size, label and hit-rate scores.

    ``k`` of 0 means as many clusters as there are training labels. Clusters of the training rows are written,
    without the features; of the silhouette only the sample is assigned.
    """
    rows = written(featured.select("doc_id", "split", "topics", "features"), "features")
    train, test = split_train_test(rows)
    model = kmeans_fit(train, choose_k(train, k), seed=seed)
    fitted = written(model.transform(train).select("doc_id", "cluster", "topics"), "fitted")
    guessed = model.transform(test).select("doc_id", "cluster", "topics")
    drawn = evaluation.silhouette_sample(train.select("doc_id", "features"), seed=seed)
    sample = model.transform(drawn).withColumn("weights", _entries("features"))
    return _scored(model, fitted, guessed, sparse.silhouettes(sample))


def sparse_report(weighted: DataFrame, k: int = 0, seed: int = 0, max_iters: int = 100) -> Report:
    """``report`` for sparse rows (doc_id, split, topics, weights) of any number of terms, as
    ``TfidfModel.transform`` gives them: k-means with sparse centroids, nothing cut to fit."""
    rows = written(weighted.select("doc_id", "split", "topics", "weights"), "features")
    train, test = split_train_test(rows)
    model = sparse.sparse_kmeans(train, choose_k(train, k), max_iters, seed)
    fitted = written(model.predict(train), "fitted")
    guessed = model.predict(test).select("doc_id", "cluster", "topics")
    return _scored(model, fitted, guessed, sparse.silhouettes(evaluation.silhouette_sample(fitted, seed=seed)))


def _scored(model, fitted: DataFrame, guessed: DataFrame, sample: DataFrame) -> Report:
    top = evaluation.top_labels(evaluation.cluster_label_counts(fitted))
    spread = sample.agg(F.avg("silhouette").alias("silhouette"))
    scores = evaluation.pseudo_purity(fitted).select(
        "pseudo_purity",
        evaluation.top_label_hit_rate(guessed, top).scalar().alias("hit_rate"),
        spread.scalar().alias("silhouette"),
    )
    return Report(model, fitted, guessed, top, scores)


def _entries(vector: str) -> Column:
    """The entries of an ML vector that are not 0, for the rows of a sample."""

    @F.udf("array<struct<idx:int,weight:double>>")
    def entries(found):
        if hasattr(found, "indices"):
            return [(int(i), float(v)) for i, v in zip(found.indices, found.values) if v]
        return [(i, float(v)) for i, v in enumerate(found.toArray()) if v]

    return entries(vector)


def cluster_labels(rep: Report) -> DataFrame:
    """(cluster, size, rank, label, n): the printed summary of a clustering. Every cluster with
    members is listed; one without labels has one row, whose rank, label and count are null."""
    sizes = evaluation.cluster_sizes(rep.train)
    return sizes.join(rep.top_labels, "cluster", "left").select("cluster", "size", "rank", "label", "n")


def compare_all(
    docs: DataFrame, k: int = 0, max_features: int = 20_000, stop_words: DataFrame | None = None, seed: int = 0
) -> tuple[dict[str, Report], DataFrame]:
    """Dense vectors, tf-idf, and small tf-idf without stop words, by default the English ones; scores
    of each and of each pair."""
    if stop_words is None:
        stop_words = english_stop_words(docs.sparkSession)
    prepared = prepare(docs) if "terms" not in docs.columns else docs
    reports = {
        "dense": report(dense_features(prepared, seed=seed), k, seed),
        "tfidf": report(tfidf_features(prepared, max_features), k, seed),
        "small_tfidf": report(
            tfidf_features(prepared, max(max_features // 10, 1), stop_words), k, seed
        ),
    }
    wide = None
    for name, rep in reports.items():
        column = rep.train.select("doc_id", F.col("cluster").alias(name))
        wide = column if wide is None else wide.join(column, "doc_id")
    cells = written(evaluation.pair_contingency(wide, list(reports)), "cells")
    return reports, evaluation.compare_clusterings(cells)
