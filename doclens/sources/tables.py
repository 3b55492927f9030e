"""Vocabulary, vector, label and shard files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.operators.numbering import row_numbers
from doclens.schemas import VECTORS, VOCABULARY


def vocab_path(folder: str, level: str, min_reps: int, most_common: int | None) -> str:
    """The parameters are part of the path, so a changed cap never meets a stale file."""
    return f"{folder}/level={level}/min_reps={min_reps}/most_common={most_common or 'all'}"


def write_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").parquet(path)


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCABULARY).parquet(path)


def export_vocab_csv(vocab: DataFrame, path: str) -> None:
    """``symbol,id`` lines. Everything is quoted: commas, quotes and line breaks are symbols too."""
    vocab.select("symbol", "id").write.mode("overwrite").option("quoteAll", True).option(
        "escape", '"'
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def import_vocab_csv(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema("symbol string, id int")
        .option("multiLine", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("emptyValue", "")
        .csv(path)
    )


def write_vectors(vecs: DataFrame, path: str) -> None:
    """(doc_id, split, vec), one folder per split, so reading one split skips the other."""
    vecs.write.mode("overwrite").partitionBy("split").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)


def cached_vectors(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The vectors at ``path``; built and written first unless a finished write left its mark there."""
    try:
        spark.read.format("binaryFile").load(f"{path}/_SUCCESS").limit(1).count()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        write_vectors(build(), path)
    return read_vectors(spark, path)


def write_labels(docs: DataFrame, path: str) -> None:
    """One ``doc_id,labels`` line per document, labels joined by commas."""
    label_lines(docs).write.mode("overwrite").option("quoteAll", True).csv(path)


def label_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.array_join("topics", ",").alias("labels"))


def shard_plan(docs: DataFrame, records_per: int = 500) -> DataFrame:
    """Add ``shard``: documents of a split by rising length, ``records_per`` to a shard.

    Lengths and ids are numbered, not documents; these are fetched by (split, doc_id), which must be
    unique."""
    sized = docs.select("split", "doc_id", F.size("ids").alias("_len"))
    numbered = row_numbers(sized, [F.col("_len"), F.col("doc_id")], ["split"], "_rn").drop("_len")
    placed = numbered.withColumn("shard", F.floor((F.col("_rn") - 1) / records_per))
    return docs.join(placed, ["split", "doc_id"]).select(*docs.columns, "_rn", "shard")


def write_training_shards(docs: DataFrame, path: str, records_per: int = 500) -> None:
    """One file per shard, shortest documents first, in a folder per split; ``shard`` is a column.

    A task holds whole shards in order, and each but the last of a split is full, so
    files cut after ``records_per`` records are the shards. At scale ask for more records.
    """
    plan = shard_plan(docs, records_per)
    (
        plan.repartition("split", "shard")
        .sortWithinPartitions("split", "shard", "_rn")
        .drop("_rn")
        .write.mode("overwrite")
        .option("maxRecordsPerFile", records_per)
        .partitionBy("split")
        .parquet(path)
    )


def read_training_shards(spark: SparkSession, path: str, train: bool) -> DataFrame:
    """The shards of one split; the other split's folders are pruned."""
    shards = spark.read.parquet(path)
    return shards.filter(F.col("split") == ("train" if train else "test"))
