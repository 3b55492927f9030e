"""Records, vectors, run logs, dense vectors and streams."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from doclens.operators import batches as B
from doclens.operators import cooccurrence as K
from doclens.operators import dense as D
from doclens.operators import runlog as G
from doclens.operators import sparse
from doclens.operators import vocab as V
from doclens.operators.weights import fit_tfidf, term_counts
from doclens.plans import training_input
from doclens.session import scratch_path, written
from doclens.sources import corpus as S
from doclens.sources import sgml, tables
from doclens.streaming import jobs
from workload import common as C
from workload import weight_queries as W
from workload.common import Registry
from workload.text_queries import BUCKETED

R = Registry()


def write_records(spark, sf) -> str:
    """The labelled documents as marked-up record files; every third text stands outside a body."""
    docs = C.labelled(spark, sf, "text")
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    topics = F.array_join(F.transform("topics", lambda t: F.concat(F.lit("<D>"), t, F.lit("</D>"))), "")
    body = F.when(F.col("doc_id") % 3 == 0, escaped).otherwise(
        F.concat(F.lit("&#2;\n<TITLE>no text</TITLE><BODY>"), escaped, F.lit("&#3;</BODY>"))
    )
    record = F.concat(
        F.lit(f"\n<{sgml.RECORD_TAG} TOPICS=\""),
        F.when(F.size("topics") > 0, "YES").otherwise("NO"),
        F.lit('" CGISPLIT="'),
        F.when(F.col("split") == "train", sgml.TRAINING_MARK).otherwise("PUBLISHED-TESTSET"),
        F.lit('" NEWID="'),
        F.col("doc_id").cast("string"),
        F.lit('">\n<TOPICS>'),
        topics,
        F.lit("</TOPICS>\n<TEXT>"),
        body,
        F.lit(f"</TEXT>\n</{sgml.RECORD_TAG}>"),
    )
    path = scratch_path(spark, "records")
    docs.select(record.alias("value")).write.text(path)
    return path


_RECORDS = (
    f"WITH {C.LABELLED} SELECT doc_id, split, array_to_string(topics, ',') AS topics, array_to_string({C.words_sql('text')}, ' ') AS text "
    "FROM labelled"
)


def _read(spark, sf, **options):
    docs = sgml.read_sgml(spark, write_records(spark, sf), glob="*.txt", **options)
    return S.text_and_labels(docs).select(
        "doc_id", "split", F.array_join("topics", ",").alias("topics"), "text"
    )


@R.add("read_sgml", _RECORDS)
def read_sgml(spark, sf):
    return _read(spark, sf)


@R.add("read_sgml_with_topics", f"{_RECORDS} WHERE len(topics) > 0")
def read_sgml_with_topics(spark, sf):
    return _read(spark, sf, everything=False)


@R.add(
    "sgml_corpus_counts",
    f"WITH {C.LABELLED}, flat AS (SELECT unnest({C.words_sql('text')}) AS symbol FROM labelled) "
    "SELECT symbol, count(*) AS n FROM flat GROUP BY symbol",
)
def sgml_corpus_counts(spark, sf):
    docs = sgml.read_sgml(spark, write_records(spark, sf), glob="*.txt")
    return V.symbol_counts(V.with_tokens(docs))


_CORPUS = f"{C.corpus_sql()}, placed AS (SELECT doc_id, {C.SPLIT} AS split, ids FROM ids)"


@R.add("sgml_corpus", f"WITH {_CORPUS} SELECT doc_id, split, array_to_string(ids, ' ') AS ids FROM placed")
def sgml_corpus(spark, sf):
    """From marked-up records to the encoded corpus, both splits."""
    corpus = S.corpus(sgml.read_sgml(spark, write_records(spark, sf), glob="*.txt"), most_common=C.CAP)
    rows = corpus.train.unionByName(corpus.test)
    return rows.select("doc_id", "split", F.array_join("ids", " ").alias("ids"))


@R.add(
    "training_input",
    f"WITH {_CORPUS}, {BUCKETED.replace('FROM ids)', 'FROM placed WHERE split = ' + chr(39) + 'train' + chr(39) + ')')}, "
    f"numbered AS (SELECT *, row_number() OVER (PARTITION BY bucket_id ORDER BY {C.hex_sql(5, 'doc_id')}, doc_id) - 1 AS rn FROM bucketed) "
    "SELECT doc_id, bucket_id, rn // 16 AS batch, (rn % 16)::INTEGER AS slot, "
    "array_to_string(list_concat(list_resize([]::INTEGER[], size - n, 4), ids), ' ') AS encoder FROM numbered",
)
def training_input_query(spark, sf):
    """From marked-up records to one epoch of padded training batches."""
    corpus = S.corpus(sgml.read_sgml(spark, write_records(spark, sf), glob="*.txt"), most_common=C.CAP)
    rows = training_input.epoch(corpus, 16, 5)
    return rows.select("doc_id", "bucket_id", "batch", "slot", F.array_join("encoder", " ").alias("encoder"))


@R.add(
    "vectors_round_trip",
    f"WITH {C.EMB} SELECT vec_id AS doc_id, CASE WHEN vec_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, "
    "round(list_sum(vec), 6) AS total, len(vec)::INTEGER AS dims FROM emb",
)
def vectors_round_trip(spark, sf):
    def build():
        return C.embeddings(spark, sf).select(
            F.col("vec_id").alias("doc_id"), C.split_of("vec_id").alias("split"), "vec"
        )

    path = scratch_path(spark, "vectors")
    tables.cached_vectors(spark, path, build)
    again = tables.cached_vectors(spark, path, build)
    total = F.aggregate("vec", F.lit(0.0), lambda t, x: t + x)
    return again.select("doc_id", "split", F.round(total, 6).alias("total"), F.size("vec").alias("dims"))


@R.add(
    "external_vectors",
    f"WITH {C.EMB} SELECT doc_id, lang, round(sqrt(list_sum(list_transform(vec, lambda x: x * x))), 6) AS norm "
    "FROM documents JOIN emb ON doc_id = vec_id",
)
def external_vectors(spark, sf):
    from doclens.functions import vectors

    vecs = C.embeddings(spark, sf).withColumnRenamed("vec_id", "doc_id")
    joined = D.with_external_vectors(C.documents(spark, sf, "doc_id", "lang"), vecs)
    return joined.select("doc_id", "lang", F.round(vectors.l2_norm(F.col("vec")), 6).alias("norm"))


# --- run log: events in time order; loss is a hundredth of the value, step time the second of the minute ---


def run_log(spark, sf, loss=None):
    events = spark.read.parquet(f"{sf}/events.parquet")
    loss = F.col("value") / 100 if loss is None else loss
    log = events.select("ts", "event_id", loss.alias("loss"), F.second("ts").cast("double").alias("step_time"))
    return G.number_steps(log, [F.col("ts"), F.col("event_id")])


_LOG = (
    "WITH log AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS step, value / 100 AS loss, "
    "extract(second FROM ts)::DOUBLE AS step_time FROM events), "
    "ckpt AS (SELECT step // 200 AS checkpoint, avg(loss) AS loss, avg(step_time) AS step_time FROM log GROUP BY 1 HAVING count(*) = 200)"
)


@R.add(
    "checkpoint_rollup",
    f"{_LOG} SELECT checkpoint, round(loss, 9) AS loss, round(step_time, 6) AS step_time, "
    "round(CASE WHEN loss < 300 THEN exp(loss) ELSE 'inf'::DOUBLE END, 6) AS perplexity FROM ckpt",
)
def checkpoint_rollup(spark, sf):
    rolled = G.checkpoint_rollup(run_log(spark, sf))
    # Means of 200 two-digit values over 100 are multiples of 5e-7: six digits would round halves.
    return rolled.select(
        "checkpoint",
        F.round("loss", 9).alias("loss"),
        *[F.round(n, 6).alias(n) for n in ("step_time", "perplexity")],
    )


@R.add(
    "plateau_drops_after_gaps",
    "WITH log AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS step, value / 100 AS loss FROM events), "
    "ckpt AS (SELECT step // 200 AS checkpoint, avg(loss) AS loss FROM log WHERE step % 1000 <> 7 GROUP BY 1 HAVING count(*) = 200), "
    "marked AS (SELECT checkpoint, loss, (row_number() OVER w > 3 AND loss > max(loss) OVER "
    "(ORDER BY checkpoint ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))::INTEGER AS dropped FROM ckpt WINDOW w AS (ORDER BY checkpoint)) "
    "SELECT checkpoint, coalesce(dropped, 0) AS dropped FROM marked",
)
def plateau_drops_after_gaps(spark, sf):
    """A log that lost a step in every fifth checkpoint, which then is none."""
    log = run_log(spark, sf).filter(F.col("step") % 1000 != 7)
    return G.plateau_drops(G.checkpoint_rollup(log)).select("checkpoint", "dropped")


@R.add(
    "plateau_drops",
    f"{_LOG}, marked AS (SELECT checkpoint, loss, (row_number() OVER w > 3 AND loss > max(loss) OVER "
    "(ORDER BY checkpoint ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))::INTEGER AS dropped FROM ckpt WINDOW w AS (ORDER BY checkpoint)) "
    "SELECT checkpoint, round(loss, 9) AS loss, coalesce(dropped, 0)::INTEGER AS dropped, "
    "round(0.01 * pow(0.9, sum(coalesce(dropped, 0)) OVER (ORDER BY checkpoint)), 9) AS rate FROM marked",
)
def plateau_drops(spark, sf):
    drops = G.plateau_drops(G.checkpoint_rollup(run_log(spark, sf)))
    return drops.select("checkpoint", F.round("loss", 9).alias("loss"), "dropped", F.round("rate", 9).alias("rate"))


@R.add(
    "nan_abort",
    "WITH log AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS step, value FROM events) "
    "SELECT min(step) FILTER (value < 1) AS first_step, count(*) FILTER (value < 1) AS n FROM log",
)
def nan_abort(spark, sf):
    """The root of value - 1 is not a number for small values."""
    return G.first_nan(run_log(spark, sf, F.sqrt(F.col("value") - 1)))


# --- dense vectors ---


@R.add("embed_documents", "SELECT doc_id, 32 AS dims, true AS is_mean FROM documents")
def embed_documents(spark, sf):
    """Document vectors against the mean of their words' vectors, joined word by word.

    Tokens are made once and written, with ids once. Words are counted in the row, and a word's vector is
    joined and added as one row: a task adds up a document before anything is shuffled."""
    tokens = C.tokenised_once(spark, sf)
    vocab = C.vocabulary(tokens)
    capped = written(D.capped_tokens(tokens, vocab), "capped")
    model = D.fit_embedding(capped, 32, seed=1)
    # As many rows as the vocabulary.
    words = F.broadcast(model.getVectors().select(F.col("word"), vector_to_array("vector").alias("_v")))
    said = term_counts(capped, "tokens", "word").join(words, "word")
    sums = said.groupBy("doc_id").agg(*[F.sum(F.col("n") * F.get("_v", i)).alias(f"_s{i}") for i in range(32)])
    wanted = sums.select("doc_id", F.array(*[F.col(f"_s{i}") for i in range(32)]).alias("_sums"))
    # The number of tokens is taken before the join, so that no tokens are shuffled.
    found = D.embed_documents(capped, model).select("doc_id", "vec", F.size("tokens").alias("_n"))
    found = found.join(wanted, "doc_id", "left")
    near = F.forall(F.zip_with("vec", "_sums", lambda x, total: F.abs(x - total / F.col("_n")) < 1e-6), lambda ok: ok)
    zero = F.forall("vec", lambda x: x == 0)
    return found.select(
        "doc_id", F.size("vec").alias("dims"), F.when(F.col("_sums").isNull(), zero).otherwise(near).alias("is_mean")
    )


PAIRS = """pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS n
    FROM (SELECT doc_id, pos, id, unnest([-5, -4, -3, -2, -1, 1, 2, 3, 4, 5]) AS d FROM enc) x
    JOIN enc y ON y.doc_id = x.doc_id AND y.pos = x.pos + x.d GROUP BY x.id, y.id),
sums AS (SELECT a, sum(n)::BIGINT AS s FROM pairs GROUP BY a),
info AS (SELECT p.a, p.b, p.n, greatest(0.0, ln(p.n::DOUBLE * (SELECT sum(s)::BIGINT FROM sums) / (x.s::DOUBLE * y.s))) AS info
    FROM pairs p JOIN sums x ON x.a = p.a JOIN sums y ON y.a = p.b)"""


@R.add(
    "cooccurrence",
    f"WITH {C.corpus_sql(300)}, {PAIRS} SELECT a, b, n, round(info, 9) AS info FROM info",
)
def cooccurrence(spark, sf):
    tokens = C.tokenised(spark, sf)
    ids = V.encode(tokens, C.vocabulary(tokens, 300))
    pairs = written(K.cooccurrences(ids, tokens="ids"), "pairs")
    return K.information(pairs).withColumn("info", F.round("info", 9))


def _few_symbols(spark, sf):
    """Ids of 40 symbols, their information, and vectors of full rank: these give each value back."""
    tokens = C.tokenised(spark, sf)
    ids = written(V.encode(tokens, C.vocabulary(tokens, 40)).select("doc_id", "ids"), "ids")
    info = written(K.information(written(K.cooccurrences(ids, tokens="ids"), "pairs")), "information")
    return ids, info, K.factorise(info, 48, seed=2)


def _dot(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


@R.add(
    "cooccurrence_vectors",
    f"WITH {C.corpus_sql(40)}, {PAIRS} SELECT a, b, n, round(info, 9) AS info, true AS recovered FROM info",
)
def cooccurrence_vectors(spark, sf):
    """Every value of the table of information, from the factors."""
    _, info, vectors = _few_symbols(spark, sf)
    left = vectors.select(F.col("symbol").alias("a"), "vec")
    both = info.join(left, "a", "left").join(vectors.select(F.col("symbol").alias("b"), "context"), "b", "left")
    near = F.abs(F.coalesce(_dot("vec", "context"), F.lit(0.0)) - F.col("info")) < 1e-3
    return both.select("a", "b", "n", F.round("info", 9).alias("info"), near.alias("recovered"))


@R.add(
    "embed_cooccurrence",
    f"WITH {C.corpus_sql(40)}, {PAIRS} SELECT t.doc_id, round(coalesce(avg(coalesce(i.info, 0)) FILTER (e.id IS NOT NULL), 0), 6) "
    "AS mean_info, true AS agrees FROM tokens t LEFT JOIN enc e USING (doc_id) LEFT JOIN (SELECT a, info FROM info WHERE b = 5) i "
    "ON i.a = e.id GROUP BY t.doc_id",
)
def embed_cooccurrence(spark, sf):
    """A document vector times the context of the commonest symbol: the mean information of its tokens with it."""
    ids, info, vectors = _few_symbols(spark, sf)
    common = info.filter("b = 5").select("a", "info")
    said = ids.select("doc_id", F.explode_outer("ids").alias("a")).join(common, "a", "left")
    means = said.groupBy("doc_id").agg(F.avg(F.coalesce("info", F.lit(0.0))).alias("mean_info"))
    context = F.array(*[F.lit(x) for x in vectors.filter("symbol = 5").first()["context"]])
    found = K.mean_vectors(ids, vectors, "ids").withColumn("context", context).join(means, "doc_id")
    agrees = F.abs(_dot("vec", "context") - F.col("mean_info")) < 1e-3
    return found.select("doc_id", F.round("mean_info", 6).alias("mean_info"), agrees.alias("agrees"))


@R.add(
    "score_model",
    f"WITH {C.corpus_sql()}, {BUCKETED}, padded AS (SELECT doc_id, bucket_id, size, list_concat(list_resize([]::INTEGER[], size - n, 4), ids) AS e "
    "FROM bucketed) SELECT doc_id, bucket_id, round(len(list_filter(e, lambda x: x = 4))::DOUBLE / size, 6) AS padding, "
    "round(list_sum(e)::DOUBLE / size, 6) AS mean_id FROM padded",
)
def score_model(spark, sf):
    """The model gives the share of padding and the mean id of each row."""

    def load_model():
        def predict(ids: np.ndarray) -> np.ndarray:
            return np.stack([(ids == 4).mean(axis=1), ids.mean(axis=1)], axis=1).astype(np.float64)

        return predict

    padded = B.inference_rows(B.bucketed(C.encoded_short(spark, sf))).select("doc_id", "bucket_id", "encoder")
    # Stored by bucket, so that each bucket's branch reads its own files.
    path = scratch_path(spark, "padded")
    padded.write.partitionBy("bucket_id").parquet(path)
    stored = spark.read.parquet(path)
    scored = D.score_model(stored, load_model)
    return scored.select(
        "doc_id",
        "bucket_id",
        F.round(F.get("vec", 0), 6).alias("padding"),
        F.round(F.get("vec", 1), 6).alias("mean_id"),
    )


# --- streams ---


def _stream(spark, sf):
    path = f"{sf}/documents.parquet"
    return jobs.read_table_stream(spark, path, spark.read.parquet(path).schema)


@R.add("stream_symbol_counts", f"WITH {C.TOKENS}, {C.FLAT}, {C.COUNTS} SELECT symbol, n FROM counts")
def stream_symbol_counts(spark, sf):
    path = scratch_path(spark, "stream-counts")
    query = (
        jobs.stream_symbol_counts(_stream(spark, sf), f"{path}/out", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return jobs.latest_counts(spark, f"{path}/out")


_STREAM = (
    f"{W.tfidf_sql(C.CAP)}, c AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1)::INTEGER AS cluster FROM documents "
    "ORDER BY doc_id LIMIT 8), cw AS (SELECT cluster, idx, w FROM c JOIN unit USING (doc_id)), "
    "own AS (SELECT doc_id, sum(w * w) AS s FROM unit GROUP BY doc_id), center AS (SELECT cluster, sum(w * w) AS s FROM cw GROUP BY cluster), "
    "dots AS (SELECT u.doc_id, cw.cluster, sum(u.w * cw.w) AS dot FROM unit u JOIN cw USING (idx) GROUP BY u.doc_id, cw.cluster), "
    "d AS (SELECT t.doc_id, c.cluster, round(sqrt(greatest(0, coalesce(own.s, 0) + coalesce(center.s, 0) - 2 * coalesce(dot, 0))), 9) AS d "
    "FROM tokens t CROSS JOIN c LEFT JOIN own ON own.doc_id = t.doc_id LEFT JOIN center ON center.cluster = c.cluster "
    "LEFT JOIN dots ON dots.doc_id = t.doc_id AND dots.cluster = c.cluster), "
    "best AS (SELECT doc_id, arg_min(cluster, (d, cluster)) AS cluster FROM d GROUP BY doc_id), "
    "sized AS (SELECT doc_id, len(tokens)::INTEGER AS n_tokens FROM tokens) "
    "SELECT doc_id, n_tokens, (CASE WHEN n_tokens < 10 THEN 0 WHEN n_tokens < 25 THEN 1 WHEN n_tokens < 50 THEN 2 "
    "WHEN n_tokens < 100 THEN 3 WHEN n_tokens < 200 THEN 4 ELSE -1 END)::INTEGER AS bucket_id, cluster FROM sized JOIN best USING (doc_id)"
)


@R.add("stream_score", _STREAM)
def stream_score(spark, sf):
    """Documents as a stream, assigned to the tf-idf vectors of the first eight documents."""
    terms = W.terms(spark, sf)
    train, _ = V.split_train_test(terms)
    model = fit_tfidf(train, max_features=C.CAP)
    first = C.documents(spark, sf, "doc_id").orderBy("doc_id").limit(8)
    seeds = model.dense_rows(terms.join(F.broadcast(first), "doc_id", "left_semi"))
    path = scratch_path(spark, "stream-score")
    query = (
        jobs.stream_score(_stream(spark, sf), model, seeds, f"{path}/out", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", "n_tokens", "bucket_id", "cluster")


@R.add("stream_score_sparse", _STREAM)
def stream_score_sparse(spark, sf):
    """The same with terms and sparse centroids in block files, as beyond the terms that are broadcast."""
    terms = W.terms(spark, sf)
    train, _ = V.split_train_test(terms)
    model = fit_tfidf(train, max_features=C.CAP)
    first = C.documents(spark, sf, "doc_id").orderBy("doc_id").limit(8)
    ids = [row["doc_id"] for row in first.collect()]
    weighted = model.transform(terms.join(F.broadcast(first), "doc_id", "left_semi"))
    items = weighted.withColumn("_item", F.array_position(F.array(*map(F.lit, ids)), F.col("doc_id")) - 1)
    path = scratch_path(spark, "stream-sparse")
    query = (
        jobs.stream_score(_stream(spark, sf), model, sparse.entries(items, "_item"), f"{path}/out", f"{path}/checkpoint", 8)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", "n_tokens", "bucket_id", "cluster")
