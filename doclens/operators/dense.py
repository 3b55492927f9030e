"""Dense document vectors: learnt on the cluster, scored by a given model, or loaded."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.operators import skipgram
from doclens.operators.lookup import bounded_rows, known_or
from doclens.schemas import BUCKETS
from doclens.session import MAX_BROADCAST_ROWS, scratch_path, written


def fit_embedding(
    docs: DataFrame,
    size: int = 64,
    tokens: str = "tokens",
    seed: int = 0,
    min_count: int = 5,
    partitions: int = 8,
    iterations: int = 1,
    key: str = "doc_id",
) -> Word2VecModel:
    """Word vectors trained on the token arrays: the steps of the library's Word2Vec (see ``skipgram``).

    ``partitions`` models are trained side by side and averaged after each of the ``iterations``, so
    both are part of the result and do not follow the cluster. Rows are dealt by ``key`` and sorted, words
    numbered by falling count, then by symbol, so runs agree. More
    data asks for more partitions, and those for more iterations. Symbols seen fewer than ``min_count`` times have
    no vector. Training keeps vocabulary x size numbers on the driver and in each task, so replace rare symbols
    first (see ``capped_tokens``).
    """
    from doclens.operators.vocab import encode, rank_symbols, symbol_counts
    from doclens.schemas import UNK

    enough = symbol_counts(docs, tokens).filter(F.col("n") >= min_count)
    ranked = written(rank_symbols(enough, None), "words")
    counts = [row["n"] for row in ranked.select("rank", "n").orderBy("rank").collect()]
    if not counts:
        raise ValueError(f"no symbol is seen {min_count} times or more")
    table = ranked.select("symbol", (F.col("rank") + UNK).cast("int").alias("id"))
    ids = encode(docs.select(key, tokens), table, tokens, "_ids", corpus_rule=False).select(key, "_ids")
    rows = ids.repartition(partitions, key).sortWithinPartitions(key, "_ids").select("_ids")
    vectors = skipgram.fit_vectors(rows, counts, size, seed, partitions, iterations, first=UNK + 1)
    named = vectors.join(ranked.select("symbol", (F.col("rank") - 1).cast("int").alias("id")), "id")
    params = {
        "vectorSize": size,
        "seed": seed,
        "minCount": min_count,
        "numPartitions": partitions,
        "maxIter": iterations,
        "inputCol": tokens,
        "outputCol": "features",
    }
    return _stored_model(named.select(F.col("symbol").alias("word"), "vector"), params)


def _stored_model(vectors: DataFrame, params: dict) -> Word2VecModel:
    """The library's model of (word, vector), by way of its file format."""
    spark = vectors.sparkSession
    path = scratch_path(spark, "model")
    vectors.write.parquet(f"{path}/data")
    metadata = {
        "class": "org.apache.spark.ml.feature.Word2VecModel",
        "timestamp": 0,
        "sparkVersion": spark.version,
        "uid": Word2Vec().uid,
        "paramMap": params,
        "defaultParamMap": {},
    }
    spark.range(0, 1, 1, 1).select(F.lit(json.dumps(metadata))).write.text(f"{path}/metadata")
    return Word2VecModel.load(path)


def capped_tokens(
    docs: DataFrame, vocab: DataFrame, tokens: str = "tokens", max_symbols: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Token arrays with symbols outside the vocabulary replaced, so training state is bounded.

    As in ``encode``, up to ``max_symbols`` are looked up inside each row, which then gives the tokens at once; with more
    the ids are joined. A null array stays null."""
    from doclens.operators.vocab import encode
    from doclens.schemas import UNK

    known = vocab.filter("kept") if "kept" in vocab.columns else vocab
    rows = bounded_rows(known.filter(F.col("id") != UNK).select("symbol"), max_symbols)
    if rows is not None:
        lookup = known_or(docs.sparkSession, [r["symbol"] for r in rows], "<UNK>")
        return docs.withColumn(tokens, lookup(F.col(tokens)))
    rewritten = F.zip_with(
        tokens, "_ids", lambda token, id_: F.when(id_ == UNK, F.lit("<UNK>")).otherwise(token)
    )
    return encode(docs, vocab, tokens, "_ids", max_symbols=max_symbols).withColumn(tokens, rewritten).drop("_ids")


def embed_documents(docs: DataFrame, model: Word2VecModel, out: str = "vec") -> DataFrame:
    """Add the mean word vector of each document."""
    return model.transform(docs).withColumn(out, vector_to_array("features")).drop("features")


def score_model(
    padded: DataFrame,
    make_predict: Callable[[], Callable],
    encoder: str = "encoder",
    out: str = "vec",
    buckets: Sequence[int] = BUCKETS,
    batch_size: int = 256,
) -> DataFrame:
    """Add a model's output for padded id arrays, many rows per call.

    ``make_predict`` loads the model once per worker and returns a function from a
    (rows, length) array to (rows, d). Rows of a bucket share a shape, so each
    bucket is one branch; store the rows partitioned by ``bucket_id`` and every
    branch reads only its own files.
    """
    branches = []
    for bucket_id, length in enumerate(buckets):
        predict = predict_batch_udf(
            make_predict,
            return_type=T.ArrayType(T.DoubleType()),
            batch_size=batch_size,
            input_tensor_shapes=[[length]],
        )
        rows = padded.filter(F.col("bucket_id") == bucket_id)
        branches.append(rows.withColumn(out, predict(F.col(encoder))))
    return reduce(DataFrame.unionByName, branches)


def with_external_vectors(docs: DataFrame, vecs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents that have a ready vector, joined by key. Both sides may be large: no hint."""
    return docs.join(vecs, key)
