"""From raw documents to shards of training text: five stages, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from doclens.llm import decontaminate, language, mixing, sharding, simhash
from doclens.session import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the byte network has learnt. Texts without a letter go, and those it
    finds more like junk than like the labelled texts; repeated and quoted passages reject none."""
    net, least = language.fit_with_rejects(language.labelled_sample(docs, sample=language.SAMPLE * 5 // 4))
    return language.accepted(docs, net, least=least)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (fingerprints of three-word shingles, three bits)."""
    return simhash.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, those of fewer than five words as a whole; items of one
    or two words are not looked for, see ``op4_containment_search``, which lists them."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_items(docs, items, short=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the target weights of their sources: a row per draw, each drawn once at least."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each draw in shards along the Hilbert curve."""
    return sharding.digest(sharding.hilbert_shards(docs))


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

# The stages train, hash and bisect, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
