"""Shared pieces of the queries and of their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.operators.vocab import build_vocab, encode, symbol_counts, with_tokens
from doclens.schemas import BUCKETS
from doclens.session import written
from doclens.sources.corpus import read_documents

CAP = 2000


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of the one-file test tables to all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(read_documents(spark, f"{sf}/documents.parquet", list(columns) or None))


def split_of(key: str = "doc_id"):
    return F.when(F.col(key) % 5 == 0, "test").otherwise("train")


def labelled(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Documents with ``topics`` and ``split``: language, quality and toxicity marks of those in
    ``labels``, no topics for the others."""
    docs = documents(spark, sf, "doc_id", "lang", *columns)
    marks = spark.read.parquet(f"{sf}/labels.parquet").withColumn("_marked", F.lit(True))
    topics = F.array_compact(
        F.array(
            F.col("lang"),
            F.when(F.col("quality") == 1, "quality"),
            F.when(F.col("toxic") == 1, "toxic"),
        )
    )
    return (
        docs.join(marks, "doc_id", "left")
        .withColumn(
            "topics", F.when(F.col("_marked"), topics).otherwise(F.array().cast("array<string>"))
        )
        .withColumn("split", split_of())
        .select("doc_id", *columns, "topics", "split")
    )


def tokenised(spark: SparkSession, sf: str, level: str = "word") -> DataFrame:
    docs = documents(spark, sf, "doc_id", "text")
    return with_tokens(docs, level).select("doc_id", "tokens")


def tokenised_once(spark: SparkSession, sf: str) -> DataFrame:
    """``tokenised``, written: for queries that read the tokens more than once."""
    return written(tokenised(spark, sf), "tokens")


def vocabulary(tokens: DataFrame, most_common: int | None = CAP, min_reps: int = 1) -> DataFrame:
    return written(build_vocab(symbol_counts(tokens), min_reps, most_common), "vocab")


def encoded(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Encoded documents (doc_id, ids), written once, and their vocabulary. Tokens are made once and
    written, for the counts and for the ids."""
    tokens = tokenised_once(spark, sf)
    vocab = vocabulary(tokens)
    return written(encode(tokens, vocab).select("doc_id", "ids"), "encoded"), vocab


def encoded_short(spark: SparkSession, sf: str) -> DataFrame:
    """Encoded documents that fit a bucket. Tokens are made once and written, for the counts and for the
    ids. An id array is as long as its tokens, so the others are left out before they are encoded."""
    tokens = tokenised_once(spark, sf)
    short = tokens.filter(F.size("tokens") < BUCKETS[-1])
    return written(encode(short, vocabulary(tokens)).select("doc_id", "ids"), "encoded")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    table = spread(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return table.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


# --- SQL fragments ---

_WS = (
    r"\x{0009}-\x{000d}\x{001c}-\x{0020}\x{0085}\x{00a0}\x{1680}"
    r"\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def words_sql(text: str) -> str:
    """The word tokeniser as an expression over ``text``."""
    folded = f"replace(replace(replace(lower({text}), 'ß', 'ss'), 'ς', 'σ'), 'ſ', 's')"
    numbers = rf"regexp_replace({folded}, '(?:\p{{Nd}}+[.,]?)+', ' <NUMBER> ', 'g')"
    stops = f"regexp_replace({numbers}, '[.?!]', ' <STOP> ', 'g')"
    marks = rf"regexp_replace({stops}, '[^\p{{L}}\p{{N}}_{_WS}<>]', ' <PUNCT> ', 'g')"
    return f"list_filter(regexp_split_to_array({marks}, '[{_WS}]+'), lambda x: x <> '')"


CHARS = "list_filter(string_split(text, ''), lambda x: x <> '')"
TOKENS = f"tokens AS (SELECT doc_id, {words_sql('text')} AS tokens FROM documents)"
CHAR_TOKENS = f"tokens AS (SELECT doc_id, {CHARS} AS tokens FROM documents)"
FLAT = "flat AS (SELECT doc_id, unnest(tokens) AS symbol, generate_subscripts(tokens, 1) - 1 AS pos FROM tokens)"
COUNTS = "counts AS (SELECT symbol, count(*) AS n FROM flat GROUP BY symbol)"
SPECIALS = (
    "specials AS (SELECT * FROM (VALUES ('<GO>', 0), ('<UNK>', 1), ('<STOP>', 2), ('<PUNCT>', 3), "
    "('<PAD>', 4)) AS t(symbol, id))"
)


def vocab_sql(most_common: int | None = CAP, min_reps: int = 1) -> str:
    cap = "" if most_common is None else f"WHERE rank <= {most_common}"
    keep = "" if min_reps <= 1 else f"WHERE n > {min_reps} OR rank = 1"
    return f"""ranked AS (SELECT * FROM (SELECT symbol, n, row_number() OVER (ORDER BY n DESC, symbol) AS rank
    FROM counts) {cap}),
kept AS (SELECT * FROM ranked {keep}),
{SPECIALS},
vocab AS (SELECT s.symbol, s.id, coalesce(k.n, 0) AS n, k.n IS NOT NULL AS kept
    FROM specials s LEFT JOIN kept k USING (symbol)
  UNION ALL
  SELECT symbol, (4 + row_number() OVER (ORDER BY rank))::INTEGER AS id, n, true AS kept
    FROM kept WHERE symbol NOT IN (SELECT symbol FROM specials))"""


ENCODED_FLAT = (
    "enc AS (SELECT f.doc_id, f.pos, coalesce(v.id, 1) AS id FROM flat f "
    "LEFT JOIN (SELECT symbol, id FROM vocab WHERE kept) v USING (symbol))"
)
ENCODED = (
    "ids AS (SELECT t.doc_id, coalesce(e.ids, []) AS ids FROM tokens t LEFT JOIN "
    "(SELECT doc_id, list(id ORDER BY pos) AS ids FROM enc GROUP BY doc_id) e USING (doc_id))"
)


def corpus_sql(most_common: int | None = CAP, min_reps: int = 1) -> str:
    """CTEs up to ``vocab``, ``enc`` (doc_id, pos, id) and ``ids`` (doc_id, ids)."""
    return ",\n".join(
        [TOKENS, FLAT, COUNTS, vocab_sql(most_common, min_reps), ENCODED_FLAT, ENCODED]
    )


SPLIT = "CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END"
LABELLED = f"""labelled AS (SELECT d.doc_id, d.text, {SPLIT.replace('doc_id', 'd.doc_id')} AS split,
    CASE WHEN l.doc_id IS NULL THEN []::VARCHAR[] ELSE list_filter([d.lang,
      CASE WHEN l.quality = 1 THEN 'quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END],
      lambda x: x IS NOT NULL) END AS topics
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
EMB = "emb AS (SELECT vec_id, embedding::DOUBLE[] AS vec, label FROM embeddings)"


def unit_sql(seed: int | str, *keys: str) -> str:
    """The seeded hash as a number in [0, 1)."""
    text = " || ':' || ".join([f"'{seed}'", *[f"{key}::VARCHAR" for key in keys]])
    return f"(('0x' || substr(md5({text}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def hex_sql(seed: int | str, *keys: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"{key}::VARCHAR" for key in keys]])
    return f"md5({text})"


class Registry:
    """Queries and SQL by name, registered side by side."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(query):
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return register
