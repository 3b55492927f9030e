"""Word vectors: the library's steps, by partial models that are apart."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.feature import Word2Vec
from pyspark.sql import functions as F

import __spark_entry__ as contract
from doclens.operators import dense as D
from doclens.operators import vocab as V

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, tokens array<string>"


def _vectors(model):
    return {r["word"]: r["vector"].toArray().tolist() for r in model.getVectors().collect()}


def _texts(counts, pieces, seed=3):
    rng = np.random.default_rng(seed)
    flat = [f"w{i}" for i, n in enumerate(counts) for _ in range(n)]
    rng.shuffle(flat)
    cuts = np.sort(rng.choice(len(flat), pieces - 1, replace=False))
    return [list(map(str, part)) for part in np.split(np.array(flat), cuts)]


@pytest.mark.parametrize("iterations", [1, 2])
def test_one_part_gives_the_vectors_of_the_library(spark, iterations):
    """Counts differ, so that the library numbers the words as it is done here. One text is longer than a
    sentence may be; rare words, which have no vector, stand between the others; a text has none, one is null."""
    texts = _texts([2, 3, *(20 + 7 * i for i in range(30))], 40)
    texts += [[w for text in texts for w in text][:2300], ["w0"], []]
    docs = spark.createDataFrame([*enumerate(texts)], SCHEMA)
    library = Word2Vec(
        vectorSize=6, seed=1, minCount=9, numPartitions=1, maxIter=iterations, inputCol="tokens", outputCol="features"
    ).fit(docs.repartition(1, "doc_id").sortWithinPartitions("doc_id", "tokens"))
    docs = docs.union(spark.createDataFrame([(999, None)], SCHEMA))
    found = D.fit_embedding(docs, 6, seed=1, min_count=9, partitions=1, iterations=iterations)
    wanted, found = _vectors(library), _vectors(found)
    assert found.keys() == wanted.keys() and "w0" not in found
    assert max(np.abs(np.subtract(found[w], wanted[w])).max() for w in wanted) < 1e-5


def test_runs_agree_on_equal_counts(spark):
    """Eight parts at a time, all words as frequent as each other, rows in another order."""
    rows = [*enumerate(_texts([25] * 40, 60))]
    fits = [D.fit_embedding(spark.createDataFrame(r, SCHEMA), 6, seed=1) for r in (rows, rows[::-1])]
    assert _vectors(fits[0]) == _vectors(fits[1])


def test_partial_models_are_apart(spark):
    """Words that one part alone has do not follow from how the other part's texts are written."""
    place = spark.range(200).select("id", F.pmod(F.hash("id"), F.lit(2)).alias("part")).collect()
    ids = {part: [r["id"] for r in place if r["part"] == part][:40] for part in (0, 1)}
    first = [*zip(ids[0], [[f"a{w}" for w in text] for text in _texts([30 + i for i in range(12)], 40)])]
    other = [*zip(ids[1], [[f"b{w}" for w in text] for text in _texts([31 + i for i in range(12)], 40)])]
    turned = [(i, text[::-1]) for i, text in other]
    one, two = (
        _vectors(D.fit_embedding(spark.createDataFrame(first + r, SCHEMA), 6, seed=1, partitions=2))
        for r in (other, turned)
    )
    assert {w: v for w, v in one.items() if w[0] == "a"} == {w: v for w, v in two.items() if w[0] == "a"}
    assert one != two


def test_no_frequent_symbol_is_an_error(spark):
    with pytest.raises(ValueError, match="5 times"):
        D.fit_embedding(spark.createDataFrame([(1, ["x", "y"])], SCHEMA))


def test_one_word(spark):
    """A tree of one leaf: the vector stays as it began."""
    found = _vectors(D.fit_embedding(spark.createDataFrame([(1, ["x"] * 9)], SCHEMA), 4))
    assert [*found] == ["x"] and all(0 < abs(v) <= 0.125 for v in found["x"])


def _plan(node):
    yield node
    for i in range(node.children().size()):
        yield from _plan(node.children().apply(i))


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_no_tokens_are_joined(spark):
    """Documents meet the sums of their words with a vector and a number of tokens."""
    plan = contract.queries()["embed_documents"](spark, SF)._jdf.queryExecution().optimizedPlan()
    by_document = [node for node in _plan(plan) if node.nodeName() == "Join" and "LeftOuter" in node.toString().split("\n")[0]]
    names = [node.output().apply(i).name() for node in by_document for i in range(node.output().size())]
    assert "vec" in names and "tokens" not in names


def test_tokens_are_capped_alike_by_both_ways(spark):
    """In the row and by a join: unknown and reserved symbols, empty and null arrays, repeated rows."""
    rows = [(1, ["a", "b", "zz", "a"]), (2, []), (3, None), (4, ["<STOP>", "<PUNCT>", "a"]), (1, ["a", "b", "zz", "a"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    vocab = spark.createDataFrame(
        [("a", 5, 3, True), ("b", 6, 1, True), ("<STOP>", 2, 1, True), ("<PUNCT>", 3, 0, False), ("<UNK>", 1, 0, False)],
        "symbol string, id int, n long, kept boolean",
    )
    wanted = [
        (1, ["a", "b", "<UNK>", "a"]), (1, ["a", "b", "<UNK>", "a"]), (2, []), (3, None), (4, ["<STOP>", "<UNK>", "a"])
    ]
    for most in (9, 2):
        found = D.capped_tokens(docs, vocab, max_symbols=most).select("doc_id", "tokens").collect()
        assert sorted(map(tuple, found), key=lambda r: r[0]) == wanted


def test_capped_tokens_are_made_by_the_lookup(spark, docs):
    """No second pass over the tokens, an interpreted one, behind the lookup."""
    tokens = V.with_tokens(docs)
    vocab = V.build_vocab(V.symbol_counts(tokens), most_common=10)
    plan = D.capped_tokens(tokens, vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "zip_with" not in plan
