"""Queries over tables that are folders of files, not one file each."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from doclens.streaming import jobs
from workload.check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("folders")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(3).write.parquet(f"{root}/documents.parquet")
    return str(root)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["encode_by_blocks", "stream_score", "stream_score_sparse", "stream_symbol_counts"])
def test_streams_of_a_folder(spark, folder, name):
    assert compare(contract.queries()[name](spark, folder), connect(SF), contract.oracle_sql()[name]) == ""


def test_table_stream_takes_one_table(spark, tmp_path):
    """A table that is a folder or a file, beside another one; one file to a batch."""
    rows = spark.range(40).repartition(4)
    rows.write.parquet(str(tmp_path / "a.parquet"))
    rows.write.parquet(str(tmp_path / "aa.parquet"))
    file = next((tmp_path / "aa.parquet").glob("*.parquet"))
    found = []
    for path in (tmp_path / "a.parquet", file):
        out = str(tmp_path / f"out{len(found)}")
        stream = jobs.read_table_stream(spark, str(path), rows.schema, files_per_batch=1)
        writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-cp")
        writer.trigger(availableNow=True).start().awaitTermination()
        found.append(sorted(r["id"] for r in spark.read.parquet(out).collect()))
    assert found == [list(range(40)), sorted(r["id"] for r in spark.read.parquet(str(file)).collect())]


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_word_vectors_are_added_as_rows(spark):
    """A row per word of a document, not one per number of its vector."""
    plan = contract.queries()["embed_documents"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "collect_list" not in plan
