"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.llm.common import crc_mod, read, ships

ships(__name__)

WORDS = re.compile(r"[^\W_]+")
# Bound of the labelled sample that is fitted on: so many documents of either label.
SAMPLE = 4000
# Groups in which candidates for the sample are ranked first.
GROUPS = 256


def features(text: str | None, bits: int) -> np.ndarray:
    """Distinct hashed features of a whole text: words, pairs of neighbours, pairs with one word between."""
    found = WORDS.findall((text or "").lower())
    w = np.fromiter((crc32(x.encode()) for x in found), np.uint64, len(found))
    return np.unique(np.concatenate([_slots(w, bits), _slots(_pair(w, 1), bits), _slots(_pair(w, 2), bits)]))


def _pair(w: np.ndarray, gap: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (w[:-gap] * np.uint64(2 * gap + 1) << np.uint64(20)) ^ (w[gap:] + np.uint64(gap))


def _slots(codes: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Model:
    bits: int
    bias: float
    slots: np.ndarray
    weights: np.ndarray

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << self.bits, np.float32)
        table[self.slots] = self.weights
        return table


def fit(
    rows: list[tuple[str, int]],
    bits: int = 20,
    alpha: float = 2.0,
    beta: float = 1.0,
    l1: float = 12.0,
    l2: float = 1.0,
    epochs: int = 4,
    seed: int = 7,
) -> Model:
    """FTRL-proximal with per-coordinate rates (McMahan et al. 2013): a weight stays exactly zero until
    its summed gradients exceed ``l1``, so few coordinates are kept and sent out.

    Both labels weigh the same in sum. With one label only, or no rows, the model is a constant.
    """
    rng = np.random.default_rng(seed)
    known = [(features(text, bits).astype(np.int32), label) for text, label in rows]
    labels = np.array([label for _, label in known], np.int64)
    share = labels.mean() if len(labels) else 0.0
    if share in (0.0, 1.0):
        bias = 0.0 if not len(labels) else (4.0 if share else -4.0)
        return Model(bits, bias, np.zeros(0, np.int64), np.zeros(0, np.float32))
    weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        pull = np.sign(z[at]) * l1 - z[at]
        return np.where(np.abs(z[at]) <= l1, 0.0, pull / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(len(known)):
            at, label = known[i]
            w = weights(at)
            b = -zb / ((beta + nb**0.5) / alpha + l2)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - label) * weight[label]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    every = np.arange(1 << bits)
    final = weights(every)
    slots = np.flatnonzero(final)
    bias = -zb / ((beta + nb**0.5) / alpha + l2)
    return Model(bits, float(bias), slots, final[slots].astype(np.float32))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text"
) -> list[tuple[str, int]]:
    """At most ``sample`` texts of either label, those of the smallest key hashes.

    Rows with a null key, or a label other than 0 and 1, teach nothing. Only keys are ranked, first in
    ``GROUPS`` groups by a second hash, then the ``GROUPS * sample`` of a label that are left, so no task's
    input grows with the rows; then the chosen texts are fetched. Their order is that of the hash, so a
    repeat fits the same model.
    """
    marks = labels.select(F.col(key), F.col("toxic").cast("int").alias("_label")).filter("_label in (0, 1)").dropna()
    order = [F.xxhash64(key).alias("_order"), F.col(key), F.col("_label")]
    ids = docs.select(key).filter(F.col(key).isNotNull()).join(marks, key).select(*order).distinct()
    chosen = ids.withColumn("_group", F.pmod(F.xxhash64(F.lit("group"), key), F.lit(GROUPS)))
    for names in (["_label", "_group"], ["_label"]):
        order = Window.partitionBy(*names).orderBy("_order", key)
        chosen = chosen.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= sample)
    chosen = chosen.drop("_group", "_rank")
    rows = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(chosen), key).orderBy("_order", key, "_text")
    return [(r["_text"], r["_label"]) for r in rows.select("_text", "_label").collect()]


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row, from its whole text alone, in one pass without a shuffle.

    Only the non-zero weights are sent out. Null and empty texts have no features and score the
    bias. Repeated rows score alike; a null key is kept; other columns are not read.
    """
    narrow = docs.select(F.col(key), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.dense()
        for batch in batches:
            sums = [float(table[features(body.as_py(), model.bits)].sum()) for body in batch.column(1)]
            odds = np.clip(np.array(sums) + model.bias, -30, 30)
            scores = pa.array(1 / (1 + np.exp(-odds)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], [key, "score"])

    kind = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, score double")


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text")
    labels = read(spark, sf, "labels", "doc_id", "toxic")
    held_out = crc_mod("doc_id", 5) == 0
    model = fit(labelled_sample(docs.filter(~held_out), labels.filter(~held_out)))
    return score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
