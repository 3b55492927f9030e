from pyspark.sql import functions as F

from doclens.plans import clustering_report as P
from doclens.plans import training_input as T
from doclens.sources import corpus as S


def themed(spark):
    """Two themes of words, each with its label; one document in six is unlabelled."""
    def word(names, i):
        return F.get(F.array(*[F.lit(n) for n in names]), F.pmod(F.col("id") * 7 + i * 3, F.lit(4)).cast("int"))

    def text(names):
        return F.concat_ws(" ", *[word(names, i) for i in range(8)])

    animals, goods = ["cat", "dog", "fish", "bird"], ["grain", "cocoa", "price", "tonne"]
    even = F.col("id") % 2 == 0
    return spark.range(60).select(
        F.col("id").alias("doc_id"),
        F.when(even, text(animals)).otherwise(text(goods)).alias("text"),
        F.when(F.col("id") % 6 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(F.when(even, "animals").otherwise("goods")))
        .alias("topics"),
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
    )


def test_report_finds_the_themes(spark):
    rep = P.report(P.tfidf_features(P.prepare(themed(spark)), 100), k=0, seed=1)
    top = {r["cluster"]: r["label"] for r in P.cluster_labels(rep).filter("rank = 1").collect()}
    assert set(top.values()) == {"animals", "goods"}
    scores = rep.scores.first()
    assert scores["pseudo_purity"] > 0.7
    # Two of the twelve test documents have no label.
    assert scores["hit_rate"] == 10 / 12


def test_repeatable_dense_features(spark):
    one, two = (
        sorted((r["doc_id"], r["features"].toArray().tolist()) for r in P.dense_features(docs, 6, repeatable=True).collect())
        for docs in (P.prepare(themed(spark)), P.prepare(themed(spark).repartition(5)))
    )
    assert one == two and len(one) == 60
    rep = P.report(P.dense_features(P.prepare(themed(spark)), 6, repeatable=True), k=2, seed=1)
    assert {r["label"] for r in P.cluster_labels(rep).filter("rank = 1").collect()} == {"animals", "goods"}


def test_compare_all(spark):
    stop = spark.createDataFrame([("cat",), ("grain",)], "term string")
    reports, pairs = P.compare_all(themed(spark), k=2, max_features=100, stop_words=stop)
    assert set(reports) == {"dense", "tfidf", "small_tfidf"}
    rows = {r["pair"]: r for r in pairs.collect()}
    assert set(rows) == {"dense~tfidf", "dense~small_tfidf", "tfidf~small_tfidf"}
    assert rows["tfidf~small_tfidf"]["ari"] > 0.9


def test_training_input(spark):
    parts = S.corpus(themed(spark), most_common=6)
    rows = T.epoch(parts, 16).collect()
    assert len(rows) == 48
    assert all(len(r["encoder"]) == len(r["decoder"]) == len(r["weights"]) == r["bucket_len"] for r in rows)
    assert all(sum(r["weights"]) == len(r["ids"]) for r in rows)
    assert T.sampled_steps(parts, 4, 8).count() == 32
    sentences = spark.sql("SELECT 'Cat, dog.' AS text")
    row = T.sentence_input(sentences, parts.vocab).first()
    assert (row["bucket_len"], row["decoder"]) == (10, [0] * 10)


def test_report_lists_every_cluster(spark):
    plain = themed(spark).withColumn("topics", F.when(F.array_contains("topics", "goods"), F.col("topics")).otherwise(F.array().cast("array<string>")))
    rep = P.report(P.tfidf_features(P.prepare(plain), 100), k=2, seed=1)
    listed = P.cluster_labels(rep).collect()
    assert {r["cluster"] for r in listed} == {0, 1} and sum({r["cluster"]: r["size"] for r in listed}.values()) == 48
    assert any(r["label"] is None for r in listed)
    assert -1 <= rep.scores.first()["silhouette"] <= 1


def test_left_out_by_length(spark):
    docs = themed(spark)
    row = P.left_out(docs, P.prepare(docs, 5)).first()
    assert (row["n_docs"], row["n_kept"], row["n_left_out"]) == (60, 0, 60)


def test_stop_words_by_default(spark):
    words = {r["term"] for r in P.english_stop_words(spark).collect()}
    assert {"the", "of", "i"} <= words


def test_a_report_assigns_its_rows_once(spark, monkeypatch):
    lookups, capped = [], P.capped_tokens
    monkeypatch.setattr(P, "capped_tokens", lambda *given: lookups.append(1) or capped(*given))
    rep = P.report(P.dense_features(P.prepare(themed(spark)), 6), k=2, seed=1)
    assert len(lookups) == 1
    # What is compared later are written clusters, not the features assigned anew.
    assert rep.train.inputFiles() and all("/fitted-" in file for file in rep.train.inputFiles())
    assert rep.train.count() == 48 and rep.train.columns == ["doc_id", "cluster", "topics"]
