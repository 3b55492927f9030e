"""Streams over documents: scoring against fixed centroids, and running symbol counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from doclens.functions.text import joined, word_terms
from doclens.operators import sparse
from doclens.operators.blockfile import BLOCK, write_blocks
from doclens.operators.clustering import nearest_by_terms
from doclens.operators.lengths import bucket_or_missing
from doclens.operators.vocab import symbol_counts, with_tokens
from doclens.operators.weights import TfidfModel


def score_documents(docs: DataFrame, model: TfidfModel, centroids: list[list[float]]) -> DataFrame:
    """(doc_id, n_tokens, bucket_id, cluster) of raw documents, batch or stream.

    The cluster is that of the centroid nearest to the document's tf-idf vector over all fitted terms;
    a document without any has the zero vector. Tokenising, weighting and assigning all work inside
    the row, so a stream keeps no state. The centroids here are dense rows; for more terms than are
    broadcast see ``score_sparse``.
    """
    if model.rows is None:
        raise ValueError("dense centroids have as many numbers as terms: give sparse ones, see score_sparse")
    terms = [row["term"] for row in model.rows]
    nearest = nearest_by_terms(docs.sparkSession, terms, [row["idf"] for row in model.rows], centroids)
    return _scored(docs, nearest)


def score_sparse(docs: DataFrame, model: TfidfModel, centroids: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``score_documents`` for any number of terms: (item, idx, value) centroids 0 to k - 1, such as those of
    ``sparse.sparse_kmeans``. Terms and centroids are looked up in block files, so an executor's memory
    follows neither."""
    terms = write_blocks(model.terms.select("term", F.col("idx").cast("bigint").alias("idx"), "idf"), "term", block)
    index, squares = sparse.index_of(centroids, k, block)
    return _scored(docs, sparse.nearest_by_terms(terms, index, squares))


def _scored(docs: DataFrame, nearest) -> DataFrame:
    return with_tokens(docs).select(
        "doc_id",
        F.size("tokens").alias("n_tokens"),
        bucket_or_missing(F.size("tokens")).alias("bucket_id"),
        nearest(word_terms(joined(F.col("tokens")))).alias("cluster"),
    )


def read_document_stream(
    spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """The files of a folder that match ``glob``. For one table, a file or a folder of files, see
    ``read_table_stream``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def read_table_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """One table as a stream: a file, or all files of a folder. The last part of the path is given as a pattern
    that matches nothing but itself, as a stream takes a plain path for a folder; a filter on file names would
    leave out the files of a table that is a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    folder, _, name = path.rstrip("/").rpartition("/")
    return reader.parquet(f"{folder}/{{{name}}}")


def stream_score(
    stream: DataFrame, model: TfidfModel, centroids: list[list[float]] | DataFrame, path: str, checkpoint: str, k: int = 0
) -> DataStreamWriter:
    """Scored documents appended to Parquet, each exactly once. ``centroids`` are dense rows, or a table of
    ``k`` sparse ones."""
    scored = score_sparse(stream, model, centroids, k) if isinstance(centroids, DataFrame) else score_documents(stream, model, centroids)
    return (
        scored
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )


# Runs of a level that are merged into one of the next.
FAN = 8


def _runs(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Level -> numbers of its runs that were written to the end, in order."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found: dict[int, list[int]] = {}
    if files.exists(folder):
        for mark in files.globStatus(jvm.org.apache.hadoop.fs.Path(path, "level=*/run=*/_SUCCESS")) or []:
            run = mark.getPath().getParent()
            level = int(run.getParent().getName().partition("=")[2])
            found.setdefault(level, []).append(int(run.getName().partition("=")[2]))
    return {level: sorted(found[level]) for level in sorted(found)}


def _run_path(path: str, level: int, run: int) -> str:
    return f"{path}/level={level}/run={run}"


def _drop(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(symbol, n) of some runs: counts only grow, so the largest is the newest."""
    rows = spark.read.schema("symbol string, n bigint").parquet(*paths)
    return rows.groupBy("symbol").agg(F.max("n").alias("n"))


def _compact(spark: SparkSession, path: str, batch: int, fan: int) -> None:
    """Merge the runs of a level that has ``fan`` of them into one of the next level, lowest level first.

    A merged run holds what its sources hold, and the largest count wins, so sources that are still
    there, after a failure or because a reader may use them, change nothing. They go at the next call."""
    for level, runs in _runs(spark, path).items():
        above = _runs(spark, path).get(level + 1, [])
        done = [run for run in runs if above and run <= above[-1]]
        for run in done:
            _drop(spark, _run_path(path, level, run))
        left = [run for run in runs if run not in done and run < batch]
        if len(left) >= fan:
            merged = _read_runs(spark, [_run_path(path, level, run) for run in left])
            merged.write.mode("overwrite").parquet(_run_path(path, level + 1, left[-1]))


def stream_symbol_counts(stream: DataFrame, path: str, checkpoint: str, level="word", fan: int = FAN) -> DataStreamWriter:
    """Running symbol counts as log-structured runs. A batch writes the symbols it changed, with their
    counts so far, to a run of its own; ``fan`` runs of a level are merged into one of the next. So a batch
    costs what it changed, and a symbol is rewritten once per level. A batch that is run again after a
    failure replaces its run. State is one row per symbol."""

    def store(changed: DataFrame, batch: int) -> None:
        changed.select("symbol", "n").write.mode("overwrite").parquet(_run_path(path, 0, batch))
        _compact(changed.sparkSession, path, batch, fan)

    return (
        symbol_counts(with_tokens(stream, level))
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(store)
    )


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, n) so far: all finished runs, merged."""
    paths = [_run_path(path, level, run) for level, runs in _runs(spark, path).items() for run in runs]
    if not paths:
        return spark.createDataFrame([], "symbol string, n bigint")
    return _read_runs(spark, paths)
