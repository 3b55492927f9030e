"""Texts are tokenised once: what is read later are written tokens."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from doclens.sources import corpus as S
from workload import common as C

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.mark.parametrize("name", ["encode", "icf_tfidf_symbols", "pad_and_bucket", "sample_batch", "tfidf_smooth", "tfidf_sparse_vectors"])
def test_results_read_written_tokens(spark, name):
    assert not any("documents.parquet" in file for file in contract.queries()[name](spark, SF).inputFiles())


@pytest.mark.parametrize("module, run", [(C, C.encoded), (S, lambda spark, sf: S.corpus(C.labelled(spark, sf, "text")))])
def test_encoding_reads_written_tokens(spark, monkeypatch, module, run):
    read, encode = [], module.encode
    monkeypatch.setattr(module, "encode", lambda docs, vocab: read.extend(docs.inputFiles()) or encode(docs, vocab))
    run(spark, SF)
    assert read and not any("documents.parquet" in file for file in read)
