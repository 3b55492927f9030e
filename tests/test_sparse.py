"""Block files, sparse geometry, exact sums and frequent keys, each against plain arithmetic."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doclens.functions.text import has_words
from doclens.operators import blockfile, sparse
from doclens.operators import clustering as K
from doclens.operators import evaluation as E
from doclens.operators import vocab as V
from doclens.operators.lookup import frequent_keys, skew_safe_lookup
from doclens.operators.weights import fit_tfidf
from doclens.plans import clustering_report as P
from doclens.streaming import jobs
from tests.test_plans import themed

ROWS = "doc_id long, weights array<struct<idx:int,weight:double>>, cluster int"


def sparse_rows(n, width, seed, clusters=4):
    pick = random.Random(seed)
    rows = []
    for i in range(n):
        idx = sorted(pick.sample(range(width), pick.randrange(0, min(8, width))))
        rows.append((i, [(t, pick.choice([0.5, 1.0, -0.25, pick.random()])) for t in idx], pick.randrange(clusters)))
    return rows


def dense(rows, width):
    table = np.zeros((len(rows), width))
    for i, (_, entries, _) in enumerate(rows):
        for t, w in entries:
            table[i, t] = w
    return table


# --- block files ---


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_values_by_text_key(spark, block):
    words = [f"w{i}" for i in range(300)] + ["é", "𝒳", "", "z"]
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    file = blockfile.write_blocks(table, "word", block)
    assert len(file.firsts) >= min(300 // block, 300) and file.firsts == sorted(file.firsts)
    import pyarrow as pa

    asked = ["w7", "none", "", "𝒳", "w299", "~", "é", "w0"]
    found = file.reader().values(pa.array(asked), "n").to_pylist()
    assert found == [dict(zip(words, range(len(words)))).get(w) for w in asked]


def test_rows_of_a_key_stay_in_one_block(spark):
    rows = [(k % 40, i) for i, k in enumerate(range(4000))]
    file = blockfile.write_blocks(spark.createDataFrame(rows, "idx long, item long"), "idx", 30)
    reader = file.reader()
    sizes = [len(reader.block(b)) for b in range(len(file.firsts))]
    keys = [set(reader.block(b).column("idx").to_pylist()) for b in range(len(file.firsts))]
    assert sum(sizes) == 4000 and sum(map(len, keys)) == 40 and max(sizes) == 100
    asked = [-3, 0, 0, 5, 39, 39, 70]
    assert [asked[a:b] for block, a, b in reader.parts(asked) if 39 in keys[block]] == [[39, 39, 70]]


def test_memory_of_a_reader_does_not_follow_the_table(spark):
    file = blockfile.write_blocks(spark.range(100_000).select(F.col("id").alias("idx"), F.col("id").alias("item")), "idx", 100)
    reader = file.reader()
    for block, _, _ in reader.parts(list(range(100_000))):
        reader.block(block)
    assert len(file.firsts) > 900 and len(reader.open) == blockfile.OPEN


def test_empty_block_file(spark):
    import pyarrow as pa

    file = blockfile.write_blocks(spark.createDataFrame([], "word string, n long"), "word")
    assert file.reader().values(pa.array(["a", "b"]), "n").to_pylist() == [None, None]


# --- silhouettes and k-means ---


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_sparse_silhouette_equals_dense(spark, block):
    rows = sparse_rows(120, 30, 1) + [(900, [], 1), (901, [(2, 0.0)], 1)]
    rows += [(1000 + i, rows[5][1], 2) for i in range(6)]
    frame = spark.createDataFrame(rows, ROWS)
    found = {r["doc_id"]: r["silhouette"] for r in sparse.silhouettes(frame, block=block).collect()}
    wide = spark.createDataFrame([(r[0], v.tolist(), r[2]) for r, v in zip(rows, dense(rows, 30))], "doc_id long, vec array<double>, cluster int")
    for r in E.silhouettes(wide).collect():
        assert found[r["doc_id"]] == pytest.approx(r["silhouette"], abs=1e-9)


def test_silhouette_of_a_million_terms_sends_no_wide_row(spark):
    rows = [(i, [(i % 7 * 1_000_000, 1.0), (9_000_000 + i, 0.5)], i % 7) for i in range(70)]
    found = sparse.silhouettes(spark.createDataFrame(rows, ROWS)).collect()
    # 0.5 apart in two places from the own cluster, and in four from the others
    inner, outer = np.sqrt(0.5), np.sqrt(2.5)
    assert all(r["silhouette"] == pytest.approx((outer - inner) / outer) for r in found)


def test_odd_silhouettes(spark):
    rows = spark.createDataFrame([(1, None, 0), (2, [(0, 1.0)], 0), (2, [(0, 1.0)], 0), (3, [(1, 1.0)], None), (4, [(1, 1.0)], 1)], ROWS)
    found = sorted((r["doc_id"], r["silhouette"]) for r in sparse.silhouettes(rows).collect())
    assert found == [(1, None), (2, 1.0), (2, 1.0), (3, None), (4, 0.0)]
    assert sparse.silhouettes(rows.limit(0)).count() == 0
    with pytest.raises(ValueError, match="sample"):
        sparse.silhouettes(rows, limit=2)
    wide = spark.createDataFrame([(1, [0.0] * 10, 0)] * 3, "doc_id long, vec array<double>, cluster int")
    E.MAX_CENTROID_VALUES, before = 25, E.MAX_CENTROID_VALUES
    try:
        with pytest.raises(ValueError, match="sparse"):
            E.silhouettes(wide)
    finally:
        E.MAX_CENTROID_VALUES = before


def test_sparse_kmeans_equals_dense(spark):
    rows = [r for r in sparse_rows(150, 12, 3) if r[1]]
    table = dense(rows, 12)
    frame = spark.createDataFrame(rows, ROWS).drop("cluster")
    seeds = spark.createDataFrame([(i, t, w) for i, r in enumerate(rows[:5]) for t, w in r[1]], "item long, idx long, value double")
    model = sparse.sparse_kmeans(frame, 5, 50, initial=seeds, block=4)
    points = spark.createDataFrame([(r[0], v.tolist()) for r, v in zip(rows, table)], "doc_id long, vec array<double>")
    other = K.kmeans_lloyd(points, 5, 50, initial=table[:5].tolist())
    assert model.converged and other.converged
    found = {r["doc_id"]: r["cluster"] for r in model.predict(frame).collect()}
    assert found == {r["doc_id"]: r["cluster"] for r in other.predict(points).collect()}
    centers = np.zeros((5, 12))
    for r in model.centroids.collect():
        centers[r["item"], r["idx"]] = r["value"]
    assert np.allclose(centers, other.centroids, atol=1e-12)


def test_sparse_kmeans_over_five_million_terms(spark):
    """Two themes without a common term but one; nothing as wide as the terms is made."""
    base = spark.range(4000).select(
        F.col("id").alias("doc_id"), (F.col("id") % 2).alias("theme"),
        F.array(*[
            F.struct((F.pmod(F.xxhash64("id", F.lit(j)), F.lit(2_500_000)) + (F.col("id") % 2) * 2_500_000).cast("int").alias("idx"), F.lit(0.3).alias("weight"))
            for j in range(6)
        ]).alias("_w"),
    )
    mark = F.struct((F.col("theme") * 4_999_999).cast("int").alias("idx"), F.lit(0.8).alias("weight"))
    rows = base.select("doc_id", "theme", F.array_sort(F.array_append("_w", mark)).alias("weights"))
    model = sparse.sparse_kmeans(rows, 2, 20, seed=3)
    pairs = {tuple(r) for r in model.predict(rows).select("theme", "cluster").distinct().collect()}
    assert model.converged and len(pairs) == 2 and len({c for _, c in pairs}) == 2
    assert model.centroids.count() > 15_000


def test_sparse_kmeans_is_the_same_for_any_partitions(spark):
    frame = spark.createDataFrame(sparse_rows(300, 40, 8), ROWS).drop("cluster")
    found = [
        sorted(map(tuple, sparse.sparse_kmeans(frame.repartition(n), 4, 6, seed=1).centroids.select("item", "idx", "value").collect()))
        for n in (2, 23)
    ]
    assert found[0] == found[1]


# --- exact sums ---


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e200])
def test_kmeans_sums_are_the_same_bits(spark, scale):
    rng = np.random.default_rng(4)
    points = [(i, (v * scale * 10.0 ** rng.integers(-9, 1)).tolist()) for i, v in enumerate(rng.normal(size=(400, 3)))]
    frame = spark.createDataFrame(points, "doc_id long, vec array<double>")
    models = [K.kmeans_lloyd(frame.repartition(n), 4, 7) for n in (1, 8, 100)]
    assert models[0].centroids == models[1].centroids == models[2].centroids
    assigned = models[0].assignments(frame).collect()
    for c, center in enumerate(models[0].centroids):
        mean = np.mean([r["vec"] for r in assigned if r["cluster"] == c], axis=0)
        assert np.allclose(center, mean, rtol=1e-12, atol=1e-15 * scale)


def test_limbs_add_up_exactly():
    rng = np.random.default_rng(5)
    values = rng.normal(size=(5000, 1)) * 1e6
    unit = 2.0**-17
    whole, below = K._limbs(values, unit)
    total = np.zeros((3, 1), np.int64)
    for start in range(0, 5000, 700):
        part = slice(start, start + 700)
        total += np.stack([below[part].sum(axis=0), whole[part].sum(axis=0), np.zeros(1, np.int64)])
        total = K._carried(total)
    from fractions import Fraction

    exact = float(sum(map(Fraction, values.ravel().tolist())))
    assert K._total(total, unit)[0] == pytest.approx(exact, rel=1e-15)
    assert (0 <= total[:2]).all() and (total[:2] < 1 << 40).all()


def test_vectors_must_be_finite(spark):
    frame = spark.createDataFrame([(1, [float("nan")]), (2, [1.0])], "doc_id long, vec array<double>")
    with pytest.raises(ValueError, match="NaN"):
        K.kmeans_lloyd(frame, 1)


# --- frequent keys ---


def test_frequent_keys_are_all_found(spark):
    pick = random.Random(6)
    keys = [pick.choice([None, "hot", "hot", "warm"]) if pick.random() < 0.5 else f"k{i}" for i in range(20_000)]
    facts = spark.createDataFrame([(k,) for k in keys], "key string").repartition(7)
    exact = Counter(k for k in keys if k is not None)
    for capacity in (2, 10, 50):
        found = {r["key"]: r["at_least"] for r in frequent_keys(facts, "key", capacity).collect()}
        assert len(found) <= capacity
        assert all(n <= exact[k] for k, n in found.items())
        assert {k for k, n in exact.items() if n > 2 * sum(exact.values()) / capacity} <= set(found)
    assert frequent_keys(facts.limit(0), "key").count() == 0


def test_a_frequent_unknown_is_no_hot_task(spark):
    """One unknown on a third of the tokens, another third null: what is shuffled has no frequent key."""
    facts = spark.range(30_000).select(
        "id", F.when(F.col("id") % 3 == 0, "unknown").when(F.col("id") % 3 == 1, F.concat(F.lit("w"), F.col("id"))).alias("key")
    )
    table = spark.range(0, 30_000, 2).select(F.concat(F.lit("w"), F.col("id")).alias("key"), F.col("id").alias("n"))
    hot = [r["key"] for r in frequent_keys(facts, "key", 100).collect()]
    assert hot == ["unknown"]
    rest = facts.filter(F.col("key").isNotNull() & ~F.col("key").isin(hot)).repartition(8, "key")
    sizes = sorted(r["count"] for r in rest.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]
    plain = facts.join(table, "key", "left").select("id", "key", "n")
    found = skew_safe_lookup(facts, table, "key", 100).select("id", "key", "n")
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, plain.collect()))


# --- encoding and scoring over block files ---


def test_encode_by_blocks_equals_encode(spark, docs):
    tokens = V.with_tokens(docs).unionByName(V.with_tokens(docs).withColumn("tokens", F.lit(None).cast("array<string>")).limit(1))
    vocab = V.build_vocab(V.symbol_counts(tokens), most_common=None)
    table = V._lookup_table(vocab, True)
    wanted = sorted(map(str, V.encode(tokens, vocab).collect()))
    for head, block in ((0, 3), (4, 3), (1000, 100)):
        assert sorted(map(str, V._encode_by_blocks(tokens, table, "tokens", "ids", head, block).collect())) == wanted


def test_sparse_scores_equal_dense_scores(spark, docs):
    terms = V.with_tokens(docs).withColumn("terms", F.col("tokens"))
    from doclens.functions.text import joined, word_terms

    terms = terms.withColumn("terms", word_terms(joined(F.col("tokens"))))
    model = fit_tfidf(terms, min_df=1, max_df=1.0)
    few = terms.filter("doc_id in (1, 2, 5)")
    seeds = model.transform(few).withColumn("_item", F.array_position(F.array(F.lit(1), F.lit(2), F.lit(5)), F.col("doc_id").cast("int")) - 1)
    found = jobs.score_sparse(docs, model, sparse.entries(seeds, "_item"), 3, block=2)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, jobs.score_documents(docs, model, model.dense_rows(few)).collect()))


def test_sparse_report(spark):
    rows = P.prepare(themed(spark))
    model = fit_tfidf(rows.filter("split = 'train'"), max_features=None)
    rep = P.sparse_report(model.transform(rows), k=2, seed=1)
    top = {r["cluster"]: r["label"] for r in P.cluster_labels(rep).filter("rank = 1").collect()}
    assert set(top.values()) == {"animals", "goods"}
    scores = rep.scores.first()
    assert scores["pseudo_purity"] > 0.7 and scores["hit_rate"] == 10 / 12 and 0 < scores["silhouette"] <= 1
    other = P.report(P.tfidf_features(rows, 100), k=2, seed=1).scores.first()
    assert scores["silhouette"] == pytest.approx(other["silhouette"])


# --- one tokeniser ---


def test_a_filter_on_length_does_not_tokenise_twice(spark, docs):
    def passes(frame):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("regexp_replace")

    once = passes(V.with_tokens(docs).select("doc_id", "tokens"))
    assert passes(V.short_documents(docs, 20).select("doc_id", "tokens")) == once
    assert passes(V.with_tokens(docs).filter(F.size("tokens") < 20).select("doc_id", "tokens")) > once
    found = V.short_documents(docs, 20).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 2, 3, 5, 10]


def test_long_texts_are_left_out_untokenised(spark):
    blanks = [chr(c) for c in range(0x110000) if chr(c).isspace()]
    apart = [" ", "  ", "\n", " \n ", "　", "  ", *blanks]
    words = ["cat", "É", "İ", "ß", "1,000.5", "!", "<", "_", "\x01", "\x01a", "字", "\U0001f600", "ŉ"]
    texts = [gap.join([word] * n) + end for gap in apart for word in words for n in (3, 4, 5) for end in ("", gap)]
    texts += [None, "", " ", "a.b.c.d", "cat " * 9000, "cat" * 9000, "\n" * 9000, " 　" * 9000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = V.short_documents(docs, 4).select("doc_id", "tokens")
    plain = V.with_tokens(docs).filter(F.size("tokens") < 4).select("doc_id", "tokens")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    # The text is looked at below the shuffle, and the tokens are made above it.
    spread = V.short_documents(docs.repartition(3), 4)._jdf.queryExecution().optimizedPlan().toString()
    assert spread.index("Generate explode") < spread.index("Repartition") < spread.index("Filter NOT coalesce(RLIKE(text")
    kept = docs.filter(~F.coalesce(has_words(F.col("text"), 4), F.lit(False)))
    assert not kept.filter("text like 'cat cat cat cat cat%'").count()
