"""Vocabulary, encoding, length and corpus queries."""

from pyspark.sql import functions as F

from doclens.operators import lengths as L
from doclens.operators import vocab as V
from doclens.operators.lookup import frequent_keys, unnest
from doclens.session import scratch_path
from doclens.sources import corpus as K
from doclens.sources import sgml, tables
from doclens.streaming import jobs
from workload import common as C
from workload.common import Registry

R = Registry()
_BASE = f"WITH {C.TOKENS}, {C.FLAT}, {C.COUNTS}"


@R.add("symbol_counts", f"{_BASE} SELECT symbol, n FROM counts")
def symbol_counts(spark, sf):
    return V.symbol_counts(C.tokenised(spark, sf))


@R.add("vocab_min_reps", f"{_BASE}, {C.vocab_sql(None, 3)} SELECT symbol, n, rank FROM kept")
def vocab_min_reps(spark, sf):
    ranked = V.rank_symbols(V.symbol_counts(C.tokenised(spark, sf)), None)
    return V.kept_symbols(ranked, 3)


@R.add("vocab_top_n", f"{_BASE}, {C.vocab_sql(1000)} SELECT symbol, n, rank FROM ranked")
def vocab_top_n(spark, sf):
    return V.rank_symbols(V.symbol_counts(C.tokenised(spark, sf)), 1000)


@R.add("vocab_ids", f"{_BASE}, {C.vocab_sql()} SELECT symbol, id, n, kept FROM vocab")
def vocab_ids(spark, sf):
    return V.build_vocab(V.symbol_counts(C.tokenised(spark, sf)), most_common=C.CAP)


@R.add("vocab_ids_uncapped", f"{_BASE}, {C.vocab_sql(None, 2)} SELECT symbol, id, n, kept FROM vocab")
def vocab_ids_uncapped(spark, sf):
    return V.build_vocab(V.symbol_counts(C.tokenised(spark, sf)), min_reps=2, most_common=None)


@R.add(
    "vocab_level",
    f"WITH {C.CHAR_TOKENS}, {C.FLAT}, {C.COUNTS}, {C.vocab_sql(200)} SELECT symbol, id, n FROM vocab",
)
def vocab_level(spark, sf):
    chars = C.tokenised(spark, sf, "char")
    return V.build_vocab(V.symbol_counts(chars), most_common=200).select("symbol", "id", "n")


@R.add("encode", f"WITH {C.corpus_sql()} SELECT doc_id, pos::INTEGER AS pos, id FROM enc")
def encode(spark, sf):
    tokens = C.tokenised_once(spark, sf)
    return unnest(V.encode(tokens, C.vocabulary(tokens)), ["doc_id"], F.col("ids"), "pos", "id")


@R.add("encode_by_join", f"WITH {C.corpus_sql(None)} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ids")
def encode_by_join(spark, sf):
    tokens = C.tokenised_once(spark, sf)
    vocab = C.vocabulary(tokens, None)
    return V.encode_by_join(tokens, vocab, capacity=1000).select("doc_id", F.array_join("ids", " ").alias("ids"))


@R.add("encode_by_blocks", f"WITH {C.corpus_sql(None)} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM ids")
def encode_by_blocks(spark, sf):
    """A stream of documents, its rare symbols looked up in a sorted file."""
    tokens = C.tokenised(spark, sf)
    vocab = C.vocabulary(tokens, None)
    path = f"{sf}/documents.parquet"
    stream = V.with_tokens(jobs.read_table_stream(spark, path, spark.read.parquet(path).schema))
    path = scratch_path(spark, "stream-ids")
    encoded = V.encode(stream, vocab, max_symbols=1000).select("doc_id", F.array_join("ids", " ").alias("ids"))
    writer = encoded.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select("doc_id", "ids")


@R.add(
    "frequent_symbols",
    f"WITH {C.TOKENS}, {C.FLAT}, {C.COUNTS} SELECT symbol, n FROM counts WHERE n > (SELECT sum(n) FROM counts) / 100",
)
def frequent_symbols(spark, sf):
    """Symbols on more than one per cent of the tokens: a summary of 200 counters names all of them, and
    these are counted."""
    flat = unnest(C.tokenised(spark, sf), [], F.col("tokens"), "symbol")
    named = frequent_keys(flat, "symbol", 200).select("symbol")
    marked = flat.join(F.broadcast(named.withColumn("_named", F.lit(True))), "symbol", "left")
    counts = marked.groupBy(F.when(F.col("_named"), F.col("symbol")).alias("symbol")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.filter(F.col("symbol").isNotNull() & (F.col("n") > total / 100)).select("symbol", "n")


@R.add(
    "split_train_test",
    f"SELECT doc_id, {C.SPLIT} AS split FROM documents",
)
def split_train_test(spark, sf):
    docs = C.documents(spark, sf, "doc_id").withColumn("split", C.split_of())
    train, test = V.split_train_test(docs)
    return train.unionByName(test)


@R.add(
    "oov_rate",
    f"{_BASE}, {C.vocab_sql()} SELECT (SELECT count(*) FROM counts) AS symbols_seen, "
    "(SELECT count(*) FROM counts) - (SELECT count(*) FROM kept) AS symbols_removed, "
    "(SELECT count(*) FROM vocab) AS vocab_size, (SELECT max(id) FROM vocab)::BIGINT AS last_id, "
    "round(1 - (SELECT sum(n) FROM kept)::DOUBLE / (SELECT sum(n) FROM counts), 6) AS oov_rate",
)
def oov_rate(spark, sf):
    from doclens.session import written

    counts = written(V.symbol_counts(C.tokenised(spark, sf)), "counts")
    vocab = V.build_vocab(counts, most_common=C.CAP)
    return V.vocab_summary(counts, vocab).withColumn("oov_rate", F.round("oov_rate", 6))


@R.add(
    "length_stats",
    f"WITH {C.TOKENS} SELECT round(avg(len(tokens)), 6) AS mean_len, round(stddev_pop(len(tokens)), 6) AS sd_len, "
    "max(len(tokens))::BIGINT AS max_len, min(len(tokens))::BIGINT AS min_len FROM tokens",
)
def length_stats(spark, sf):
    stats = V.length_stats(C.tokenised(spark, sf))
    return stats.withColumn("mean_len", F.round("mean_len", 6)).withColumn("sd_len", F.round("sd_len", 6))


@R.add(
    "corpus_size",
    f"WITH {C.LABELLED}, t AS (SELECT split, topics, {C.words_sql('text')} AS tokens FROM labelled) "
    "SELECT split, count(*) AS n, count(*) FILTER (len(topics) > 0) AS n_labelled, "
    "count(*) FILTER (len(tokens) < 200) AS n_short FROM t GROUP BY split",
)
def corpus_size(spark, sf):
    docs = V.with_tokens(C.labelled(spark, sf, "text"))
    return docs.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.size("topics") > 0).alias("n_labelled"),
        F.count_if(F.size("tokens") < 200).alias("n_short"),
    )


@R.add(
    "derive_split",
    "SELECT doc_id, CASE WHEN CASE WHEN lang = 'en' THEN 'TRAINING-SET' WHEN lang <> 'de' THEN 'OTHER' END "
    "= 'TRAINING-SET' THEN 'train' ELSE 'test' END AS split FROM documents",
)
def derive_split(spark, sf):
    mark = F.when(F.col("lang") == "en", sgml.TRAINING_MARK).when(F.col("lang") != "de", "OTHER")
    return C.documents(spark, sf, "doc_id", "lang").select("doc_id", sgml.derive_split(mark).alias("split"))


@R.add(
    "filter_topics_flag",
    f"WITH {C.LABELLED} SELECT doc_id, len(topics)::INTEGER AS n_topics FROM labelled WHERE len(topics) > 0",
)
def filter_topics_flag(spark, sf):
    docs = C.labelled(spark, sf)
    return docs.filter(F.size("topics") > 0).select("doc_id", F.size("topics").alias("n_topics"))


@R.add(
    "text_and_labels",
    f"WITH {C.LABELLED} SELECT doc_id, array_to_string({C.words_sql('text')}, ' ') AS text, array_to_string(topics, ',') AS topics "
    "FROM labelled SEMI JOIN labels USING (doc_id) WHERE split = 'train'",
)
def text_and_labels(spark, sf):
    ids = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id")
    rows = K.text_and_labels(C.labelled(spark, sf, "text"), ids, "train")
    return rows.select("doc_id", "text", F.array_join("topics", ",").alias("topics"))


@R.add(
    "corpus",
    f"WITH {C.corpus_sql()}, {C.LABELLED} SELECT doc_id, split, array_to_string(ids, ' ') AS ids, "
    "array_to_string(topics, ',') AS topics FROM ids JOIN labelled USING (doc_id)",
)
def corpus(spark, sf):
    parts = K.corpus(C.labelled(spark, sf, "text"), most_common=C.CAP)
    return parts.train.unionByName(parts.test).select(
        "doc_id", "split", F.array_join("ids", " ").alias("ids"), F.array_join("topics", ",").alias("topics")
    )


@R.add("vocab_round_trip", f"{_BASE}, {C.vocab_sql(C.CAP, 2)} SELECT symbol, id, n, kept FROM vocab")
def vocab_round_trip(spark, sf):
    from doclens.session import scratch_path

    vocab = V.build_vocab(V.symbol_counts(C.tokenised(spark, sf)), 2, C.CAP)
    path = tables.vocab_path(scratch_path(spark, "vocab-table"), "word", 2, C.CAP)
    tables.write_vocab(vocab, path)
    return tables.read_vocab(spark, path)


@R.add(
    "vocab_csv",
    f"WITH {C.CHAR_TOKENS}, {C.FLAT}, {C.COUNTS}, {C.vocab_sql(300)} SELECT symbol, id FROM vocab",
)
def vocab_csv(spark, sf):
    from doclens.session import scratch_path

    path = scratch_path(spark, "vocab-csv")
    chars = C.tokenised(spark, sf, "char")
    tables.export_vocab_csv(V.build_vocab(V.symbol_counts(chars), most_common=300), path)
    return tables.import_vocab_csv(spark, path)


@R.add(
    "write_labels",
    f"WITH {C.LABELLED} SELECT doc_id, array_to_string(topics, ',') AS labels FROM labelled",
)
def write_labels(spark, sf):
    from doclens.session import scratch_path

    path = scratch_path(spark, "labels")
    tables.write_labels(C.labelled(spark, sf), path)
    lines = spark.read.schema("doc_id long, labels string").option("emptyValue", "").csv(path)
    return lines.withColumn("labels", F.coalesce("labels", F.lit("")))


_SHARDS = (
    f"WITH {C.corpus_sql()}, placed AS (SELECT doc_id, {C.SPLIT} AS split, ids FROM ids), "
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY len(ids), doc_id) AS rn FROM placed)"
)


def _encoded(spark, sf):
    return C.encoded(spark, sf)[0].withColumn("split", C.split_of())


@R.add(
    "shard_plan",
    f"{_SHARDS} SELECT split, (rn - 1) // 500 AS shard, count(*) AS n, min(len(ids))::INTEGER AS shortest, "
    "max(len(ids))::INTEGER AS longest FROM numbered GROUP BY split, shard",
)
def shard_plan(spark, sf):
    plan = tables.shard_plan(_encoded(spark, sf))
    return plan.groupBy("split", "shard").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("ids")).alias("shortest"),
        F.max(F.size("ids")).alias("longest"),
    )


@R.add(
    "training_shards",
    f"{_SHARDS} SELECT doc_id, split, (rn - 1) // 100 AS shard, array_to_string(ids, ' ') AS ids FROM numbered",
)
def training_shards(spark, sf):
    from doclens.session import scratch_path

    path = scratch_path(spark, "shards")
    tables.write_training_shards(_encoded(spark, sf), path, 100)
    both = [tables.read_training_shards(spark, path, train) for train in (True, False)]
    return both[0].unionByName(both[1]).select(
        "doc_id", "split", "shard", F.array_join("ids", " ").alias("ids")
    )


@R.add(
    "filter_length",
    f"WITH {C.TOKENS} SELECT doc_id, len(tokens)::INTEGER AS n_tokens FROM tokens WHERE len(tokens) < 200",
)
def filter_length(spark, sf):
    return L.filter_length(C.tokenised(spark, sf)).select("doc_id", F.size("tokens").alias("n_tokens"))


@R.add(
    "filter_encodable",
    f"WITH {C.TOKENS} SELECT doc_id, len(tokens)::INTEGER AS n_tokens FROM tokens WHERE len(tokens) <= 200",
)
def filter_encodable(spark, sf):
    return L.filter_encodable(C.tokenised(spark, sf)).select("doc_id", F.size("tokens").alias("n_tokens"))
