"""The labelled corpus as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions.text import joined
from doclens.operators.vocab import (
    build_vocab,
    encode,
    split_train_test,
    symbol_counts,
    with_tokens,
)
from doclens.session import written


def read_documents(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet corpus, only the named columns. ``spark.sql.files.maxPartitionBytes`` sets the tasks."""
    docs = spark.read.parquet(path)
    return docs.select(*columns) if columns else docs


def text_and_labels(
    docs: DataFrame, ids: DataFrame | None = None, split: str = "both", level="word"
) -> DataFrame:
    """(doc_id, text, topics, split): text is the tokens joined by blanks.

    ``split`` is ``train``, ``test`` or ``both``. ``ids`` is a (doc_id) table;
    None means all. Filters come before the tokeniser.
    """
    if split != "both":
        docs = docs.filter(F.col("split") == split)
    if ids is not None:
        docs = docs.join(ids.select("doc_id"), "doc_id", "left_semi")
    return with_tokens(docs, level).select(
        "doc_id", joined(F.col("tokens")).alias("text"), "topics", "split"
    )


@dataclass
class Corpus:
    train: DataFrame
    test: DataFrame
    vocab: DataFrame


def corpus(
    docs: DataFrame, level="word", min_reps: int = 1, most_common: int | None = 10_000
) -> Corpus:
    """Encoded training and test documents, and the vocabulary counted over both.

    Documents are read and tokenised once and the tokens written; one pass over these counts, one
    encodes. Vocabulary and encoded documents are written to the shared folder, the latter in a folder
    per split, so batching reads ids of one split and never tokenises again.
    """
    tokens = docs if "tokens" in docs.columns else with_tokens(docs, level)
    tokens = written(tokens.select("doc_id", "tokens", "topics", "split"), "tokens")
    vocab = written(build_vocab(symbol_counts(tokens), min_reps, most_common), "vocab")
    encoded = encode(tokens, vocab).select("doc_id", "ids", "topics", "split")
    train, test = split_train_test(written(encoded, "encoded", ["split"]))
    return Corpus(train, test, vocab)
