import pytest
from pyspark.sql import functions as F

from doclens.operators import vocab as V
from doclens.operators.lookup import skew_safe_lookup
from doclens.operators.numbering import hashed_row_numbers, row_numbers, running_sum
from doclens.schemas import SPECIAL_IDS
from doclens.sources import corpus as S


def table(vocab):
    return {r["symbol"]: (r["id"], r["n"], r["kept"]) for r in vocab.collect()}


def counts(spark, **n):
    return spark.createDataFrame(list(n.items()), "symbol string, n long")


def test_ids_are_dense_after_the_reserved_ones(spark, docs):
    vocab = table(V.build_vocab(V.symbol_counts(V.with_tokens(docs)), most_common=None))
    assert {s: vocab[s][0] for s in SPECIAL_IDS} == SPECIAL_IDS
    assert sorted(v[0] for v in vocab.values()) == list(range(len(vocab)))
    assert vocab["<GO>"] == (0, 0, False)


@pytest.mark.parametrize("min_reps, left", [(1, "abcd"), (2, "ab"), (3, "a"), (9, "a")])
def test_min_reps_drops_counts_up_to_the_limit_but_never_the_top(spark, min_reps, left):
    vocab = V.build_vocab(counts(spark, a=5, b=3, c=2, d=1), min_reps, 10)
    assert set(table(vocab)) - set(SPECIAL_IDS) == set(left)


def test_the_cap_ranks_reserved_symbols_too(spark):
    seen = spark.createDataFrame([("<STOP>", 9), ("a", 8), ("<PUNCT>", 2), ("b", 2)], "symbol string, n long")
    vocab = table(V.build_vocab(seen, most_common=2))
    assert vocab["<STOP>"] == (2, 9, True)
    assert vocab["<PUNCT>"] == (3, 0, False)
    assert vocab["a"][0] == 5 and "b" not in vocab


def test_capped_and_uncapped_numbering_agree(spark, docs):
    seen = V.symbol_counts(V.with_tokens(docs)).cache()
    for min_reps in (1, 2):
        assert table(V.build_vocab(seen, min_reps, 10**6)) == table(V.build_vocab(seen, min_reps, None))


def test_a_cut_reserved_symbol_encodes_as_unknown_in_the_corpus_only(spark):
    seen = spark.createDataFrame([("a", 8), ("<PUNCT>", 2)], "symbol string, n long")
    vocab = V.build_vocab(seen, most_common=1)
    rows = spark.sql("SELECT 1L AS doc_id, array('a', '<PUNCT>', 'zz') AS tokens")
    assert V.encode(rows, vocab).first()["ids"] == [5, 1, 1]
    assert V.encode(rows, vocab, corpus_rule=False).first()["ids"] == [5, 3, 1]


def test_lookup_and_join_encode_alike(spark, docs):
    tokens = V.with_tokens(docs)
    vocab = V.build_vocab(V.symbol_counts(tokens), most_common=6)

    def ids(df):
        return {r["doc_id"]: r["ids"] for r in df.select("doc_id", "ids").collect()}

    inside = ids(V.encode(tokens, vocab))
    assert inside == ids(V.encode_by_join(tokens, vocab, capacity=2))
    assert inside == ids(V.encode(tokens, vocab, max_symbols=3))
    assert inside[3] == []


def test_decode_gives_the_tokens_back(spark, docs):
    tokens = V.with_tokens(docs)
    vocab = V.build_vocab(V.symbol_counts(tokens), most_common=None)
    encoded = V.encode(tokens, vocab).drop("text")
    for decode in (V.decode, V.decode_by_join):
        for row in decode(encoded, vocab).collect():
            assert row["text"] == " ".join(row["tokens"])


def test_sentences(spark, docs):
    vocab = V.build_vocab(V.symbol_counts(V.with_tokens(docs)), most_common=None)
    row = V.tokenise_sentences(spark.sql("SELECT 'The zebra sat.' AS text"), vocab).first()
    assert row["sentence"] == "the <UNK> sat <STOP>"
    assert row["ids"][1] == 1


def test_summary_and_lengths(spark, docs):
    tokens = V.with_tokens(docs)
    seen = V.symbol_counts(tokens)
    row = V.vocab_summary(seen, V.build_vocab(seen, most_common=3)).first()
    assert row["symbols_removed"] == row["symbols_seen"] - 3
    assert 0 < row["oov_rate"] < 1
    stats = V.length_stats(tokens).first()
    assert (stats["max_len"], stats["min_len"]) == (320, 0)


def test_tokenising_twice_spoils_the_marks(spark, docs):
    row = V.special_loss(V.with_tokens(docs)).first()
    assert row["specials_once"] == row["specials_spoiled"] > 0
    assert row["specials_twice"] == 0


def test_text_and_labels_filters(spark, docs):
    ids = spark.sql("SELECT explode(array(1L, 5L, 99L)) AS doc_id")
    assert {r["doc_id"] for r in S.text_and_labels(docs, ids).collect()} == {1, 5}
    assert {r["doc_id"] for r in S.text_and_labels(docs, ids, "train").collect()} == {1}
    assert S.text_and_labels(docs).count() == 6


def test_corpus_splits(spark, docs):
    parts = S.corpus(docs, most_common=5)
    assert {r["doc_id"] for r in parts.test.collect()} == {5, 10}
    assert parts.train.count() == 4
    # Five kept symbols, one of them reserved.
    assert parts.vocab.count() == 5 + 4


def skewed(spark, n=3000):
    """A third of the rows share one key."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"),
        F.col("id"),
        F.md5(F.col("id").cast("string")).alias("hex"),
    )


def test_row_numbers_of_a_hot_key(spark):
    found = row_numbers(skewed(spark), [F.col("id").desc()], ["key"], "rn").collect()
    hot = sorted((r["rn"], r["id"]) for r in found if r["key"] == 0)
    assert hot == [(i + 1, id_) for i, id_ in enumerate(range(2997, -1, -3))]
    assert all(r["rn"] == 1 for r in found if r["key"] != 0)


def test_hashed_row_numbers(spark):
    found = hashed_row_numbers(skewed(spark), "hex", ["id"], (), "rn").collect()
    ordered = sorted(found, key=lambda r: (r["hex"], r["id"]))
    assert [r["rn"] for r in ordered] == list(range(1, 3001))


def test_running_sum_over_blocks(spark):
    rows = spark.range(1, 1001).select(F.col("id").alias("pos"), (F.col("id") % 3).alias("v"))
    found = {r["pos"]: r["s"] for r in running_sum(rows, "pos", "v", "s", block=64).collect()}
    total = 0
    for i in range(1, 1001):
        total += i % 3
        assert found[i] == total


def test_skew_safe_lookup_is_a_left_join(spark):
    facts = skewed(spark).select("id", "key")
    names = spark.range(0, 3000, 2).select(
        F.col("id").alias("key"), (F.col("id") * 2).alias("twice"), (-F.col("id")).alias("weight")
    )
    plain = facts.join(names, "key", "left")
    safe = skew_safe_lookup(facts, names, "key", capacity=10)
    assert sorted(map(str, plain.select("id", "key", "twice").collect())) == sorted(
        map(str, safe.select("id", "key", "twice").collect())
    )


ODD = [(1, None), (1, None), (1, ["a", "b"]), (1, ["a", "b"]), (2, []), (None, ["b", "zz"])]


def test_encode_and_decode_alike_on_odd_rows(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, tokens array<string>")
    vocab = V.build_vocab(V.symbol_counts(rows), most_common=None)
    inside, beyond = (V.encode(rows, vocab, max_symbols=n) for n in (1000, 1))
    assert inside.columns == beyond.columns
    key = lambda r: repr(tuple(r))
    assert sorted(inside.collect(), key=key) == sorted(beyond.collect(), key=key)
    ids = inside.drop("tokens").unionByName(inside.select("doc_id", F.lit(None).cast("array<int>").alias("ids")).limit(1))
    one, two = (V.decode(ids, vocab, max_symbols=n) for n in (1000, 1))
    assert sorted(one.collect(), key=key) == sorted(two.collect(), key=key)
    assert {r["text"] for r in one.filter("ids is null").collect()} == {""}


def test_sentences_without_a_key_beyond_the_limit(spark, docs):
    vocab = V.build_vocab(V.symbol_counts(V.with_tokens(docs)), most_common=None)
    talk = spark.createDataFrame([(1, 0, "The cat"), (1, 0, "The cat"), (2, 1, "")], "conv_id long, turn long, text string")
    one, two = (V.tokenise_sentences(talk, vocab, max_symbols=n) for n in (1000, 1))
    key = lambda r: repr(tuple(r))
    assert sorted(one.collect(), key=key) == sorted(two.collect(), key=key)
