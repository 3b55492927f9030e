"""Term weighting queries."""

from pyspark.sql import functions as F

from doclens.operators import vocab as V
from doclens.operators import weights as W
from doclens.plans import clustering_report
from doclens.session import written
from workload import common as C
from workload.common import Registry

R = Registry()
DIMS = C.CAP + 5

_ICF = (
    f"WITH {C.corpus_sql()}, cf AS (SELECT id, count(*) AS n FROM enc GROUP BY id), "
    "w AS (SELECT id, n, ln((SELECT sum(n) FROM cf)::DOUBLE / n) AS icf FROM cf), "
    "size AS (SELECT count(*) AS dims FROM vocab), "
    "tf AS (SELECT doc_id, id, count(*) AS n FROM enc GROUP BY doc_id, id)"
)


@R.add("icf_weights", f"{_ICF} SELECT id, n, round(icf, 6) AS icf FROM w")
def icf_weights(spark, sf):
    docs, _ = C.encoded(spark, sf)
    counts = written(W.corpus_counts(docs), "counts")
    return W.icf_weights(counts).withColumn("icf", F.round("icf", 6))


@R.add("term_freq", f"{_ICF} SELECT doc_id, id, n, round(n::DOUBLE / dims, 9) AS tf FROM tf, size")
def term_freq(spark, sf):
    docs, vocab = C.encoded(spark, sf)
    return W.term_freqs(docs, vocab.count()).withColumn("tf", F.round("tf", 9))


@R.add(
    "icf_tfidf",
    f"{_ICF} SELECT doc_id, id, round(tf.n::DOUBLE / dims * icf, 9) AS weight FROM tf JOIN w USING (id), size",
)
def icf_tfidf(spark, sf):
    docs, vocab = C.encoded(spark, sf)
    weighted = W.icf_tfidf(docs, dims=vocab.count(), max_terms=DIMS)
    return weighted.withColumn("weight", F.round("weight", 9))


@R.add(
    "icf_tfidf_symbols",
    f"WITH {C.TOKENS}, {C.FLAT}, cf AS (SELECT symbol, count(*) AS n FROM flat GROUP BY symbol), "
    "w AS (SELECT symbol, n, ln((SELECT sum(n) FROM cf)::DOUBLE / n) AS icf FROM cf), "
    "tf AS (SELECT doc_id, symbol, count(*) AS n FROM flat GROUP BY doc_id, symbol) "
    "SELECT doc_id, symbol, round(tf.n::DOUBLE / (SELECT count(*) FROM cf) * icf, 9) AS weight "
    "FROM tf JOIN w USING (symbol)",
)
def icf_tfidf_symbols(spark, sf):
    weighted = W.icf_tfidf(C.tokenised(spark, sf), values="tokens", name="symbol")
    return weighted.withColumn("weight", F.round("weight", 9))


@R.add(
    "icf_given_counts",
    f"WITH {C.corpus_sql()}, cf AS (SELECT id, count(*) AS n FROM enc WHERE doc_id % 5 <> 0 GROUP BY id), "
    "w AS (SELECT id, n, ln((SELECT sum(n) FROM cf)::DOUBLE / n) AS icf FROM cf), "
    "tf AS (SELECT doc_id, id, count(*) AS n FROM enc WHERE doc_id % 5 = 0 GROUP BY doc_id, id) "
    "SELECT doc_id, id, round(tf.n::DOUBLE / (SELECT count(*) FROM vocab) * coalesce(icf, 0), 9) AS weight "
    "FROM tf LEFT JOIN w USING (id)",
)
def icf_given_counts(spark, sf):
    docs, vocab = C.encoded(spark, sf)
    train, test = V.split_train_test(docs.withColumn("split", C.split_of()))
    counts = written(W.corpus_counts(train), "counts")
    weighted = W.icf_tfidf(test, counts=counts, dims=vocab.count(), max_terms=DIMS)
    return weighted.withColumn("weight", F.round("weight", 9))


TOP_TERMS_SQL = (
    f"WITH {C.TOKENS}, {C.FLAT}, {C.COUNTS}, top AS (SELECT symbol FROM counts ORDER BY n DESC, symbol LIMIT {C.CAP}), "
    "enc AS (SELECT doc_id, coalesce(top.symbol, '<UNK>') AS symbol FROM flat LEFT JOIN top USING (symbol)), "
    "cf AS (SELECT symbol, count(*) AS n FROM enc GROUP BY symbol), "
    "w AS (SELECT symbol, ln((SELECT sum(n) FROM cf)::DOUBLE / n) AS icf FROM cf), "
    "tf AS (SELECT doc_id, symbol, count(*) AS n FROM enc GROUP BY doc_id, symbol), "
    "weighted AS (SELECT doc_id, symbol, round(tf.n::DOUBLE / (SELECT count(*) FROM cf) * icf, 9) AS weight "
    "FROM tf JOIN w USING (symbol)) "
    "SELECT * FROM (SELECT doc_id, symbol, weight, row_number() OVER (PARTITION BY doc_id "
    "ORDER BY weight DESC, symbol) AS rn FROM weighted) WHERE rn <= 10"
)


@R.add("top_weighted_terms", TOP_TERMS_SQL)
def top_weighted_terms(spark, sf):
    """The ten heaviest terms of each document over a capped vocabulary."""
    docs, vocab = C.encoded(spark, sf)
    return W.top_icf_terms(docs, vocab)


def tfidf_sql(features: int, smooth: int = 1, stop: str = "") -> str:
    return (
        f"WITH {C.TOKENS}, terms AS (SELECT doc_id, {C.SPLIT} AS split, unnest(regexp_extract_all(lower(array_to_string(tokens, ' ')), "
        r"'[\p{L}\p{N}_]{2,}')) AS term FROM tokens), "
        "tf AS (SELECT doc_id, split, term, count(*) AS n FROM terms GROUP BY doc_id, split, term), "
        "size AS (SELECT count(*) AS docs FROM documents WHERE doc_id % 5 <> 0), "
        "stats AS (SELECT term, count(*) AS df, sum(n)::BIGINT AS n FROM tf WHERE split = 'train' GROUP BY term), "
        f"picked AS (SELECT term, df, n FROM stats, size WHERE df >= 2 AND df <= 0.5 * docs {stop} "
        f"ORDER BY n DESC, term LIMIT {features}), "
        "fitted AS (SELECT term, (row_number() OVER (ORDER BY term) - 1)::INTEGER AS idx, df, n, "
        f"ln((1.0 + docs) / (1.0 + df)) + {smooth} AS idf FROM picked, size), "
        "raw AS (SELECT doc_id, split, idx, tf.n * idf AS w FROM tf JOIN fitted USING (term)), "
        "unit AS (SELECT doc_id, split, idx, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM raw)"
    )


def terms(spark, sf):
    docs = C.tokenised(spark, sf)
    from doclens.functions.text import joined, word_terms

    return docs.select(
        "doc_id", C.split_of().alias("split"), word_terms(joined(F.col("tokens"))).alias("terms")
    )


def terms_once(spark, sf):
    """``terms``, written: for queries that fit on them and weigh them."""
    return written(terms(spark, sf), "terms")


@R.add("tfidf_fit", f"{tfidf_sql(2000)} SELECT term, idx, df, n, round(idf, 6) AS idf FROM fitted")
def tfidf_fit(spark, sf):
    train, _ = V.split_train_test(terms(spark, sf))
    return W.fit_tfidf(train, max_features=2000).terms.withColumn("idf", F.round("idf", 6))


@R.add(
    "tfidf_fit_uncapped",
    f"{tfidf_sql(10**9)} SELECT term, idx, df, n, round(idf, 6) AS idf FROM fitted",
)
def tfidf_fit_uncapped(spark, sf):
    train, _ = V.split_train_test(terms(spark, sf))
    return W.fit_tfidf(train, max_features=None).terms.withColumn("idf", F.round("idf", 6))


@R.add(
    "tfidf_transform",
    f"{tfidf_sql(2000)} SELECT doc_id, idx, round(w, 6) AS weight FROM unit WHERE split = 'test'",
)
def tfidf_transform(spark, sf):
    train, test = V.split_train_test(terms_once(spark, sf))
    model = W.fit_tfidf(train, max_features=2000)
    return model.exploded(test).withColumn("weight", F.round("weight", 6))


@R.add(
    "tfidf_smooth",
    f"{tfidf_sql(2000, 0)} SELECT doc_id, idx, round(w, 6) AS weight FROM unit WHERE split = 'train'",
)
def tfidf_smooth(spark, sf):
    train, _ = V.split_train_test(terms_once(spark, sf))
    model = W.fit_tfidf(train, max_features=2000, idf="smooth")
    return model.exploded(train).withColumn("weight", F.round("weight", 6))


_STOP = "AND term NOT IN (SELECT DISTINCT lower(b) FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]{2,}')) AS b FROM benchmark))"


@R.add(
    "tfidf_small_stop",
    f"{tfidf_sql(200, 1, _STOP)} SELECT doc_id, idx, round(w, 6) AS weight FROM unit",
)
def tfidf_small_stop(spark, sf):
    """A tenth of the features, without the words of the benchmark texts."""
    docs = terms_once(spark, sf)
    texts = spark.read.parquet(f"{sf}/benchmark.parquet")
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]{2,}"), 0)
    stop = texts.select(F.explode(words).alias("w")).select(F.lower("w").alias("term")).distinct()
    train, _ = V.split_train_test(docs)
    model = W.fit_tfidf(train, max_features=200, stop_words=stop)
    return model.exploded(docs).withColumn("weight", F.round("weight", 6))


@R.add(
    "tfidf_sparse_vectors",
    f"{tfidf_sql(2000)} SELECT doc_id, count(idx) AS entries, round(coalesce(sum(w), 0), 6) AS total "
    "FROM (SELECT doc_id FROM documents) LEFT JOIN unit USING (doc_id) GROUP BY doc_id",
)
def tfidf_sparse_vectors(spark, sf):
    """The ML stages: sparse vectors, summed up here through their numeric entries."""
    from pyspark.ml.functions import vector_to_array

    docs = terms_once(spark, sf)
    train, _ = V.split_train_test(docs)
    model = W.fit_tfidf(train, max_features=2000)
    dense = vector_to_array(F.col("features"))
    return model.to_ml().transform(docs).select(
        "doc_id",
        F.size(F.filter(dense, lambda x: x != 0)).cast("long").alias("entries"),
        F.round(F.aggregate(dense, F.lit(0.0), lambda t, x: t + x), 6).alias("total"),
    )


@R.add("tfidf_cluster_report")
def tfidf_cluster_report(spark, sf):
    """Flagship: short documents, tf-idf, k-means, the top labels of each cluster."""
    docs = C.labelled(spark, sf, "text")
    prepared = clustering_report.prepare(docs)
    rep = clustering_report.report(clustering_report.tfidf_features(prepared, C.CAP), k=8)
    return clustering_report.cluster_labels(rep)


@R.add(
    "tfidf_report_totals",
    f"WITH {C.TOKENS}, short AS (SELECT doc_id, {C.SPLIT} AS split FROM tokens WHERE len(tokens) < 200) "
    "SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM short) AS n_kept, "
    "(SELECT count(*) FROM tokens WHERE len(tokens) >= 200) AS n_left_out, "
    "(SELECT count(*) FROM short WHERE split = 'train') AS clustered, 0::BIGINT AS missing, 0::BIGINT AS too_large, true AS scored",
)
def tfidf_report_totals(spark, sf):
    """What must hold of the flagship report whatever the clusters: their sizes make up the training
    documents, each is listed, no label counts more than its cluster, and the scores are in range."""
    docs = C.labelled(spark, sf, "text")
    prepared = clustering_report.prepare(docs)
    rep = clustering_report.report(clustering_report.tfidf_features(prepared, C.CAP), k=8)
    listed = written(clustering_report.cluster_labels(rep), "listed")
    sizes = listed.select("cluster", "size").distinct().agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c"))
    found = rep.train.select("cluster").distinct().agg(F.count(F.lit(1))).scalar()
    inside = [F.col("pseudo_purity").between(0, 1), F.col("hit_rate").between(0, 1), F.col("silhouette").between(-1, 1)]
    return clustering_report.left_out(docs, prepared).select(
        "n_docs",
        F.col("n_kept").cast("long").alias("n_kept"),
        F.col("n_left_out").cast("long").alias("n_left_out"),
        sizes.select("s").scalar().alias("clustered"),
        (found - sizes.select("c").scalar()).alias("missing"),
        listed.agg(F.count_if(F.col("n") > F.col("size"))).scalar().alias("too_large"),
        rep.scores.select(inside[0] & inside[1] & inside[2]).scalar().alias("scored"),
    )


