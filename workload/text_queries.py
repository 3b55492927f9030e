"""Tokenising and text scalars."""

from pyspark.sql import functions as F

from doclens.functions import arrays, vectors
from doclens.functions.text import joined, tokenise_words, word_terms
from doclens.operators import runlog
from doclens.operators import vocab as V
from doclens.operators.lengths import bucket_or_missing
from doclens.operators.lookup import unnest
from workload import common as C
from workload.common import Registry

R = Registry()


@R.add("tokenise_words", f"WITH {C.TOKENS} SELECT doc_id, array_to_string(tokens, ' ') AS text FROM tokens")
def tokenise_words_query(spark, sf):
    return C.tokenised(spark, sf).select("doc_id", joined(F.col("tokens")).alias("text"))


@R.add(
    "tokenise_chars",
    f"WITH {C.CHAR_TOKENS}, {C.FLAT} SELECT symbol, count(*) AS n, count(DISTINCT doc_id) AS docs, "
    "min(pos)::BIGINT AS first_pos FROM flat GROUP BY symbol",
)
def tokenise_chars_query(spark, sf):
    chars = unnest(C.tokenised(spark, sf, "char"), ["doc_id"], F.col("tokens"), "pos", "symbol")
    per_doc = chars.groupBy("symbol", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    return per_doc.groupBy("symbol").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.min("p").cast("long").alias("first_pos")
    )


@R.add(
    "replace_unknown",
    f"WITH {C.TOKENS}, {C.FLAT}, {C.COUNTS}, {C.vocab_sql()} SELECT doc_id, array_to_string(list(CASE WHEN v.symbol IS NULL "
    "THEN '<UNK>' ELSE f.symbol END ORDER BY pos), ' ') AS text FROM flat f LEFT JOIN "
    "(SELECT symbol FROM vocab WHERE kept) v USING (symbol) GROUP BY doc_id "
    "UNION ALL SELECT doc_id, '' FROM tokens WHERE len(tokens) = 0",
)
def replace_unknown(spark, sf):
    from doclens.operators.dense import capped_tokens

    tokens = C.tokenised(spark, sf)
    capped = capped_tokens(tokens, C.vocabulary(tokens))
    return capped.select("doc_id", joined(F.col("tokens")).alias("text"))


_SENTENCES = (
    f"sentences AS (SELECT conv_id, turn, {C.words_sql('text')} AS tokens FROM conversations), "
    "placed AS (SELECT conv_id, turn, unnest(tokens) AS symbol, generate_subscripts(tokens, 1) AS pos "
    "FROM sentences), "
    "coded AS (SELECT conv_id, turn, list(coalesce(id, 1) ORDER BY pos) AS ids, array_to_string(list(CASE WHEN id IS NULL "
    "THEN '<UNK>' ELSE symbol END ORDER BY pos), ' ') AS sentence FROM placed LEFT JOIN vocab "
    "USING (symbol) GROUP BY conv_id, turn)"
)


@R.add(
    "tokenise_sentence",
    f"WITH {C.TOKENS}, {C.FLAT}, {C.COUNTS}, {C.vocab_sql()}, {_SENTENCES} SELECT conv_id, turn, sentence, "
    "array_to_string(ids, ' ') AS ids FROM coded UNION ALL SELECT conv_id, turn, '', '' FROM sentences WHERE len(tokens) = 0",
)
def tokenise_sentence(spark, sf):
    vocab = C.vocabulary(C.tokenised(spark, sf))
    talk = C.spread(spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text"))
    return V.tokenise_sentences(talk, vocab).select(
        "conv_id", "turn", "sentence", F.array_join("ids", " ").alias("ids")
    )


_JOINED = "array_to_string(tokens, ' ')"
_MARKS = "['<NUMBER>', '<STOP>', '<PUNCT>']"
_FOLDED = "['<number>', '<stop>', '<punct>']"


@R.add(
    "retokenise_effect",
    f"WITH {C.TOKENS}, again AS (SELECT tokens, {C.words_sql(_JOINED)} AS twice "
    f"FROM tokens) SELECT sum(len(list_filter(tokens, lambda x: list_contains({_MARKS}, x))))::BIGINT AS specials_once, "
    f"sum(len(list_filter(twice, lambda x: list_contains({_MARKS}, x))))::BIGINT AS specials_twice, "
    f"sum(len(list_filter(twice, lambda x: list_contains({_FOLDED}, x))))::BIGINT AS specials_spoiled FROM again",
)
def retokenise_effect(spark, sf):
    return V.special_loss(C.tokenised(spark, sf))


@R.add(
    "token_lengths",
    f"WITH {C.TOKENS} SELECT doc_id, len(tokens)::INTEGER AS n_tokens FROM tokens",
)
def token_lengths(spark, sf):
    return C.tokenised(spark, sf).select("doc_id", F.size("tokens").alias("n_tokens"))


_BUCKET = (
    "CASE WHEN n < 10 THEN 0 WHEN n < 25 THEN 1 WHEN n < 50 THEN 2 WHEN n < 100 THEN 3 WHEN n < 200 THEN 4 END"
)
BUCKETED = (
    f"bucketed AS (SELECT *, [10, 25, 50, 100, 200][bucket_id + 1] AS size FROM (SELECT doc_id, ids, len(ids) AS n, "
    f"({_BUCKET}) AS bucket_id FROM ids) WHERE bucket_id IS NOT NULL)"
)


def _bucketed(spark, sf):
    from doclens.operators.batches import bucketed

    return bucketed(C.encoded_short(spark, sf))


def _array_query(name, column, expression):
    """One row per bucketed document, an array as text."""

    @R.add(
        name,
        f"WITH {C.corpus_sql()}, {BUCKETED} SELECT doc_id, bucket_id, "
        f"array_to_string({expression}, ' ') AS padded FROM bucketed",
    )
    def query(spark, sf):
        rows = _bucketed(spark, sf)
        return rows.select(
            "doc_id", "bucket_id", F.array_join(column(F.col("ids"), F.col("bucket_len")), " ").alias("padded")
        )


_array_query(
    "left_pad", arrays.left_pad, "list_concat(list_resize([]::INTEGER[], size - n, 4), ids)"
)
_array_query(
    "decoder_input",
    arrays.decoder_input,
    "list_concat(list_concat([0], ids), list_resize([]::INTEGER[], size - n - 1, 4))",
)
_array_query(
    "target_weights",
    lambda ids, size: F.transform(
        arrays.target_weights(arrays.decoder_input(ids, size), size), lambda w: w.cast("int")
    ),
    "list_transform(range(1, size + 1), lambda i: CASE WHEN i <= n THEN 1 ELSE 0 END)",
)
_array_query(
    "inference_decoder",
    lambda ids, size: arrays.inference_decoder(size),
    "list_resize([]::INTEGER[], size, 0)",
)
_array_query(
    "inference_weights",
    lambda ids, size: F.transform(arrays.inference_weights(ids, size), lambda w: w.cast("int")),
    "list_transform(range(1, size + 1), lambda i: CASE WHEN i <= n THEN 1 ELSE 0 END)",
)


@R.add(
    "detokenise",
    f"WITH {C.corpus_sql()} SELECT doc_id, array_to_string(list(v.symbol ORDER BY pos), ' ') AS text "
    "FROM enc JOIN vocab v USING (id) GROUP BY doc_id UNION ALL SELECT doc_id, '' FROM tokens WHERE len(tokens) = 0",
)
def detokenise(spark, sf):
    tokens = C.tokenised(spark, sf)
    vocab = C.vocabulary(tokens)
    return V.decode(V.encode(tokens, vocab), vocab).select("doc_id", "text")


@R.add(
    "l2_normalise",
    f"WITH {C.EMB}, norms AS (SELECT vec_id, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS norm FROM emb), "
    "parts AS (SELECT vec_id, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS x, norm FROM norms) "
    "SELECT vec_id, pos::INTEGER AS pos, round(CASE WHEN norm > 0 THEN x / norm ELSE x END, 6) AS x FROM parts",
)
def l2_normalise(spark, sf):
    return C.embeddings(spark, sf).select(
        "vec_id", F.posexplode(vectors.normalise(F.col("vec"))).alias("pos", "x")
    ).withColumn("x", F.round("x", 6))


@R.add(
    "special_ids",
    f"WITH {C.TOKENS}, {C.FLAT}, {C.COUNTS}, {C.SPECIALS} SELECT symbol, id, coalesce(n, 0) AS n FROM specials "
    "LEFT JOIN counts USING (symbol)",
)
def special_ids(spark, sf):
    counts = V.symbol_counts(C.tokenised(spark, sf))
    return V.special_symbols(spark).join(counts, "symbol", "left").select(
        "symbol", "id", F.coalesce("n", F.lit(0)).alias("n")
    )


@R.add(
    "logit_argmax",
    f"WITH {C.EMB} SELECT vec_id, (list_position(vec, list_max(vec)) - 1)::INTEGER AS choice FROM emb",
)
def logit_argmax(spark, sf):
    return C.embeddings(spark, sf).select("vec_id", runlog.logit_argmax(F.col("vec")).alias("choice"))


@R.add(
    "logit_sample",
    f"WITH {C.EMB}, parts AS (SELECT vec_id, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS x FROM emb), "
    f"noisy AS (SELECT vec_id, pos, x - ln(-ln({C.unit_sql(7, 'vec_id', 'pos')} + pow(2.0, -54))) AS z FROM parts) "
    "SELECT vec_id, arg_max(pos, z)::INTEGER AS choice FROM noisy GROUP BY vec_id",
)
def logit_sample(spark, sf):
    return C.embeddings(spark, sf).select(
        "vec_id", runlog.logit_sample(F.col("vec"), 7, F.col("vec_id")).alias("choice")
    )


@R.add(
    "softmax",
    f"WITH {C.EMB}, parts AS (SELECT vec_id, list_max(vec) AS top, generate_subscripts(vec, 1) - 1 AS pos, unnest(vec) AS x FROM emb), "
    "powers AS (SELECT vec_id, pos, exp(x - top) AS p FROM parts) "
    "SELECT vec_id, pos::INTEGER AS pos, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS p FROM powers",
)
def softmax(spark, sf):
    return C.embeddings(spark, sf).select(
        "vec_id", F.posexplode(vectors.softmax(F.col("vec"))).alias("pos", "p")
    ).withColumn("p", F.round("p", 6))


@R.add(
    "find_bucket",
    f"WITH sentences AS (SELECT conv_id, turn, len({C.words_sql('text')}) AS n FROM conversations) "
    f"SELECT conv_id, turn, n::INTEGER AS n_tokens, coalesce({_BUCKET}, -1)::INTEGER AS bucket_id FROM sentences",
)
def find_bucket(spark, sf):
    talk = C.spread(spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text"))
    size = F.size(tokenise_words(F.col("text")))
    return talk.select("conv_id", "turn", size.alias("n_tokens")).withColumn(
        "bucket_id", bucket_or_missing(F.col("n_tokens"))
    )


@R.add(
    "word_terms",
    f"WITH {C.TOKENS}, terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(array_to_string(tokens, ' ')), "
    r"'[\p{L}\p{N}_]{2,}')) AS term FROM tokens) SELECT doc_id, term, count(*) AS n FROM terms GROUP BY doc_id, term",
)
def word_terms_query(spark, sf):
    terms = C.tokenised(spark, sf).select("doc_id", word_terms(joined(F.col("tokens"))).alias("terms"))
    return unnest(terms, ["doc_id"], arrays.run_lengths(F.col("terms")), "run").select(
        "doc_id", F.col("run.value").alias("term"), F.col("run.n").alias("n")
    )
