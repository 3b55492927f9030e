import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from doclens.operators import vocab as V
from doclens.operators import weights as W

ROWS = [(1, ["a", "b", "a"]), (2, ["b", "c"]), (3, ["a", "d", "d", "d"]), (4, [])]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "doc_id long, tokens array<string>")


def test_icf_weights_by_hand(spark, rows):
    counts = Counter(t for _, tokens in ROWS for t in tokens)
    total = sum(counts.values())
    found = {
        (r["doc_id"], r["symbol"]): r["weight"]
        for r in W.icf_tfidf(rows, "tokens", "symbol").collect()
    }
    for doc, tokens in ROWS:
        for symbol, n in Counter(tokens).items():
            assert found[doc, symbol] == pytest.approx(n / len(counts) * math.log(total / counts[symbol]))
    assert len(found) == 6


def test_terms_without_counts_weigh_nothing(spark, rows):
    counts = spark.createDataFrame([("a", 3), ("b", 1)], "symbol string, n long")
    for bound in (None, 10):
        found = W.icf_tfidf(rows, "tokens", "symbol", counts, dims=5, max_terms=bound)
        weights = {(r["doc_id"], r["symbol"]): r["weight"] for r in found.collect()}
        assert weights[3, "d"] == 0
        assert weights[1, "a"] == pytest.approx(2 / 5 * math.log(4 / 3))


def fitted(rows, **options):
    return W.fit_tfidf(rows, "tokens", **{"min_df": 1, "max_df": 1.0, **options})


def terms(model):
    return [(r["term"], r["idx"]) for r in model.terms.orderBy("idx").collect()]


def test_document_frequency_limits(spark, rows):
    assert terms(fitted(rows, min_df=2)) == [("a", 0), ("b", 1)]
    assert terms(fitted(rows, max_df=0.25)) == [("c", 0), ("d", 1)]


def test_features_are_the_most_frequent_numbered_by_term(spark, rows):
    assert terms(fitted(rows, max_features=2)) == [("a", 0), ("d", 1)]
    stop = spark.createDataFrame([("d",)], "term string")
    assert terms(fitted(rows, max_features=2, stop_words=stop)) == [("a", 0), ("b", 1)]


def test_weights_by_hand_and_unit_length(spark, rows):
    model = fitted(rows)
    idf = {t: math.log(5 / (1 + df)) + 1 for t, df in {"a": 2, "b": 2, "c": 1, "d": 1}.items()}
    found = {r["doc_id"]: {w["idx"]: w["weight"] for w in r["w"]} for r in model.transform(rows, "tokens", "w").collect()}
    norm = math.hypot(2 * idf["a"], idf["b"])
    assert found[1] == {0: pytest.approx(2 * idf["a"] / norm), 1: pytest.approx(idf["b"] / norm)}
    assert found[4] == {}


def test_three_ways_to_the_same_vectors(spark, rows):
    model = fitted(rows, max_features=3)
    joined = W.TfidfModel(model.terms, None)
    inside = {(r["doc_id"], r["idx"]): r["weight"] for r in model.exploded(rows, "tokens").collect()}
    by_join = {(r["doc_id"], r["idx"]): r["weight"] for r in joined.exploded(rows, "tokens").collect()}
    ml = {}
    for r in model.to_ml("tokens").transform(rows).collect():
        for i, w in zip(r["features"].indices, r["features"].values):
            ml[r["doc_id"], int(i)] = w
    assert inside == pytest.approx(by_join)
    assert inside == pytest.approx(ml)


def test_no_terms_left(spark, rows):
    model = fitted(rows, min_df=99)
    assert model.rows == []
    assert model.transform(rows, "tokens", "w").filter(F.size("w") > 0).count() == 0


def test_top_terms_break_ties_by_name(spark):
    weighted = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, "c", 0.1)], "doc_id long, symbol string, weight double")
    found = W.top_terms(weighted, "symbol", 2).orderBy("rn").collect()
    assert [r["symbol"] for r in found] == ["a", "b"]


def test_encoding_then_weighting_needs_no_corpus_shuffle(spark, docs):
    tokens = V.with_tokens(docs)
    vocab = V.build_vocab(V.symbol_counts(tokens), most_common=10)
    counted = W.term_counts(V.encode(tokens, vocab))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_transform_alike_beyond_the_limit(spark, rows):
    model = fitted(rows)
    twice = rows.unionByName(rows).drop("doc_id")
    small = W.TfidfModel(model.terms, model.rows, in_row=1)

    def found(m):
        made = m.transform(twice, "tokens", "w").collect()
        return sorted((tuple(r["tokens"] or ()), [(w["idx"], round(w["weight"], 12)) for w in r["w"]]) for r in made)

    assert found(model) == found(small)


def test_ml_vectors_without_terms(spark, rows):
    found = fitted(rows, min_df=99).to_ml("tokens").transform(rows).collect()
    assert all(r["features"].size == 1 and not r["features"].indices.size for r in found)


def test_top_terms_in_the_row(spark, docs):
    tokens = V.with_tokens(docs)
    vocab = V.build_vocab(V.symbol_counts(tokens), most_common=8)
    encoded = V.encode(tokens, vocab).select("doc_id", "ids")
    names = vocab.select("id", "symbol")
    wanted = W.top_terms(W.icf_tfidf(encoded).join(names, "id").drop("id"), "symbol", 3)
    found = W.top_icf_terms(encoded, vocab, 3)
    row = lambda r: (r["doc_id"], r["rn"], r["symbol"], r["weight"])
    assert sorted(map(row, found.collect())) == sorted(map(row, wanted.collect()))


def test_document_frequencies_need_no_lambda(spark, capsys):
    """Terms are counted by generated code; repeats, empty and null arrays give what counting by hand gives."""
    rows = [(1, ["a", "b", "a"]), (2, ["b"]), (3, []), (4, None), (5, ["a", "a", "a"])]
    counted = W.document_frequencies(spark.createDataFrame(rows, "doc_id long, terms array<string>"))
    assert sorted(map(tuple, counted.collect())) == [("a", 2, 5), ("b", 2, 2)]
    counted.explain()
    assert "lambda" not in capsys.readouterr().out
