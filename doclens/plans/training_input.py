"""From documents to padded training batches, and the encoder's input."""

from __future__ import annotations

from pyspark.sql import DataFrame

from doclens.operators.batches import (
    bucketed,
    epoch_batches,
    inference_rows,
    sample_batches,
    training_rows,
)
from doclens.operators.vocab import tokenise_sentences
from doclens.sources.corpus import Corpus


def epoch(corpus: Corpus, batch_size: int = 32, seed: int = 0) -> DataFrame:
    """Every training document once, in length buckets, padded."""
    return training_rows(epoch_batches(bucketed(corpus.train), batch_size, seed))


def sampled_steps(corpus: Corpus, steps: int, batch_size: int = 32, seed: int = 0) -> DataFrame:
    """``steps`` batches drawn with replacement, buckets by their share of the data."""
    return training_rows(sample_batches(bucketed(corpus.train), steps, batch_size, seed))


def sentence_input(sentences: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """Raw sentences as padded encoder input; sentences longer than every bucket go."""
    return inference_rows(bucketed(tokenise_sentences(sentences, vocab, text)))
