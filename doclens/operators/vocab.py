"""Symbol counts, capped vocabularies, encoding and decoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.functions import arrays
from doclens.functions.text import has_words, tokeniser
from doclens.operators.blockfile import BLOCK, write_blocks
from doclens.operators.lookup import (
    bounded_rows,
    index_lookup,
    skew_safe_lookup,
    unnest,
    with_row_number,
)
from doclens.operators.numbering import row_numbers
from doclens.schemas import FIRST_FREE_ID, SPECIAL_IDS, UNK
from doclens.session import MAX_BROADCAST_ROWS, MAX_LITERAL_VALUES


def with_tokens(
    docs: DataFrame, level="word", text: str = "text", out: str = "tokens"
) -> DataFrame:
    """Add the token array of a text column; ``level`` picks the tokeniser."""
    return docs.withColumn(out, tokeniser(level)(F.col(text)))


def short_documents(
    docs: DataFrame, max_len: int, level="word", text: str = "text", out: str = "tokens"
) -> DataFrame:
    """``with_tokens`` for documents of fewer than ``max_len`` tokens; null texts go.

    The tokens come out of a generator of one row, which the optimiser neither repeats nor filters below:
    a plain filter on their number is pushed under the projection and tokenises every text twice. Texts with
    ``max_len`` words between blanks have as many tokens or more: they are left out untokenised, where they are
    read, before any shuffle below."""
    if level == "word" and max_len > 0:
        docs = docs.filter(~F.coalesce(has_words(F.col(text), max_len), F.lit(False)))
    once = F.explode_outer(F.array(tokeniser(level)(F.col(text))))
    kept = [c for c in docs.columns if c != out]
    return docs.select(*kept, once.alias(out)).filter(F.size(out) < max_len)


def symbol_counts(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(symbol, n) over all documents. Partial sums absorb the very common symbols."""
    return (
        unnest(docs, [], F.col(tokens), "symbol")
        .groupBy("symbol")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def special_symbols(spark: SparkSession) -> DataFrame:
    values = ", ".join(f"('{symbol}', {id_})" for symbol, id_ in SPECIAL_IDS.items())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(symbol, id)")


def rank_symbols(counts: DataFrame, most_common: int | None = 10_000) -> DataFrame:
    """(symbol, n, rank): most frequent first, ties by symbol, at most ``most_common`` rows."""
    order = [F.col("n").desc(), F.col("symbol")]
    if most_common is not None and most_common <= MAX_BROADCAST_ROWS:
        top = counts.orderBy(*order).limit(most_common)
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    ranked = row_numbers(counts, order, out="rank")
    return ranked if most_common is None else ranked.filter(F.col("rank") <= most_common)


def kept_symbols(ranked: DataFrame, min_reps: int = 1) -> DataFrame:
    """Drop symbols seen ``min_reps`` times or fewer, when above 1. The top symbol always stays."""
    if min_reps <= 1:
        return ranked
    return ranked.filter((F.col("n") > min_reps) | (F.col("rank") == 1))


def build_vocab(
    counts: DataFrame, min_reps: int = 1, most_common: int | None = 10_000
) -> DataFrame:
    """(symbol, id, n, kept): the reserved symbols, then kept symbols by falling count.

    The cap ranks all symbols, reserved ones included. A reserved symbol keeps
    its id even when it is cut; ``kept`` is then false and its tokens encode as unknown.
    """
    kept = kept_symbols(rank_symbols(counts, most_common), min_reps)
    if most_common is None or most_common > MAX_BROADCAST_ROWS:
        return _number_any_size(kept)
    # At most ``most_common`` + 5 rows from here on.
    reserved = F.col("symbol").isin(*SPECIAL_IDS)
    listed = _with_reserved(kept).withColumn("_reserved", reserved)
    place = F.row_number().over(Window.partitionBy("_reserved").orderBy("rank"))
    return listed.withColumn("_place", place).select(
        "symbol",
        F.when(F.col("_reserved"), _reserved_id()).otherwise(F.col("_place") + (FIRST_FREE_ID - 1)).alias("id"),
        "n",
        "kept",
    )


def _reserved_id() -> Column:
    pairs = [F.lit(part) for pair in SPECIAL_IDS.items() for part in pair]
    return F.element_at(F.create_map(*pairs), F.col("symbol"))


def _with_reserved(kept: DataFrame) -> DataFrame:
    """(symbol, n, rank, kept) with a row for every reserved symbol, seen or not. ``kept`` is read
    once, so the corpus below it is counted once."""
    absent = special_symbols(kept.sparkSession).select(
        "symbol",
        F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("long").alias("rank"),
        F.lit(False).alias("kept"),
    )
    return (
        kept.select("symbol", "n", "rank", F.lit(True).alias("kept"))
        .unionByName(absent)
        .groupBy("symbol")
        .agg(F.sum("n").alias("n"), F.min("rank").alias("rank"), F.max("kept").alias("kept"))
    )


def _number_any_size(kept: DataFrame) -> DataFrame:
    """Ids from the ranks alone: a symbol's rank, less the reserved symbols ranked before it. Ranks
    come from a written table, so reading them twice is cheap."""
    reserved = F.col("symbol").isin(*SPECIAL_IDS)
    ranks = [row["rank"] for row in kept.filter(reserved).select("rank").collect()]
    before = sum((F.when(F.col("rank") > rank, 1).otherwise(0) for rank in ranks), F.lit(0))
    id_ = F.when(reserved, _reserved_id()).otherwise(
        (F.col("rank") - before + (FIRST_FREE_ID - 1)).cast("int")
    )
    return _with_reserved(kept).select("symbol", id_.alias("id"), "n", "kept")


def _lookup_table(vocab: DataFrame, corpus_rule: bool) -> DataFrame:
    table = vocab.filter("kept") if corpus_rule and "kept" in vocab.columns else vocab
    return table.select("symbol", "id", *(["n"] if "n" in vocab.columns else []))


def encode(
    docs: DataFrame,
    vocab: DataFrame,
    tokens: str = "tokens",
    out: str = "ids",
    corpus_rule: bool = True,
    max_symbols: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Add the id array of a token array; symbols outside the vocabulary become UNK.

    A vocabulary of at most ``max_symbols`` is looked up inside each row. A
    larger one is joined, see ``encode_by_join``; both give the same rows, with any columns,
    repeated rows and null arrays, which have no ids. ``corpus_rule`` leaves out
    reserved symbols that fell out of the cap; without it every symbol that has
    an id counts as known.
    """
    table = _lookup_table(vocab, corpus_rule)
    rows = bounded_rows(table, max_symbols)
    if rows is None and docs.isStreaming:
        return _encode_by_blocks(docs, table, tokens, out)
    if rows is None:
        return encode_by_join(docs, vocab, tokens, out, corpus_rule)
    return docs.withColumn(out, _in_row(docs, rows, tokens, UNK))


def _in_row(docs: DataFrame, rows: list, tokens: str, missing: int) -> Column:
    symbols, ids = [r["symbol"] for r in rows], [r["id"] for r in rows]
    lookup = index_lookup(docs.sparkSession, symbols, ids, missing)
    return lookup(F.coalesce(F.col(tokens), F.array().cast("array<string>")))


def _encode_by_blocks(
    docs: DataFrame, table: DataFrame, tokens: str, out: str, head: int = MAX_LITERAL_VALUES, block: int = BLOCK
) -> DataFrame:
    """A stream cannot be joined and grouped by row, so the vocabulary is looked up inside the row: its
    ``head`` most frequent symbols in a broadcast, the others in a sorted file on shared storage, of which
    a task holds some blocks. Executors hold as much at ten million symbols as at a hundred million."""
    order = [F.col("n").desc()] if "n" in table.columns else []
    common = table.orderBy(*order, "id").limit(head).collect()
    known = docs.sparkSession.sparkContext.broadcast(
        (pa.array([r["symbol"] for r in common], pa.string()), pa.array([r["id"] for r in common], pa.int32()))
    )
    file = write_blocks(table.select("symbol", "id"), "symbol", block)

    @F.arrow_udf("array<int>")
    def lookup(lists: pa.Array) -> pa.Array:
        symbols, ids = known.value
        flat = lists.flatten().dictionary_encode()
        distinct = flat.dictionary
        found = pc.take(ids, pc.index_in(distinct, value_set=symbols))
        rare = np.flatnonzero(np.asarray(found.is_null()))
        if len(rare):
            rest = file.reader().values(distinct.take(pa.array(rare)), "id").cast(pa.int32())
            at = np.full(len(distinct), -1)
            at[rare] = np.arange(len(rare))
            found = pc.coalesce(found, rest.take(pa.array(at, mask=at < 0)))
        values = pc.fill_null(found, UNK).take(flat.indices)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values.cast(pa.int32()))

    return docs.withColumn(out, lookup.asNondeterministic()(F.coalesce(F.col(tokens), F.array().cast("array<string>"))))


def encode_by_join(
    docs: DataFrame,
    vocab: DataFrame,
    tokens: str = "tokens",
    out: str = "ids",
    corpus_rule: bool = True,
    capacity: int = 10_000,
) -> DataFrame:
    """Same result as ``encode`` for a vocabulary too large to broadcast.

    Rows are numbered and written once, so they need no key of their own. Symbols that are frequent in
    the documents, known or not, are looked up in a broadcast; the others are joined by shuffle. Position
    and id travel as one long, eight bytes a token.
    """
    docs = with_row_number(docs, "_row")
    table = _lookup_table(vocab, corpus_rule).select("symbol", "id")
    flat = unnest(docs, ["_row"], F.col(tokens), "pos", "symbol")
    found = skew_safe_lookup(flat, table, "symbol", capacity)
    packed = F.shiftleft(F.col("pos").cast("long"), 32) + F.coalesce("id", F.lit(UNK))
    ids = found.groupBy("_row").agg(F.sort_array(F.collect_list(packed)).alias(out))
    ids = ids.withColumn(
        out, F.transform(out, lambda p: p.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
    )
    return docs.join(ids, "_row", "left").withColumn(
        out, F.coalesce(out, F.array().cast("array<int>"))
    ).drop("_row")


def tokenise_sentences(
    sentences: DataFrame, vocab: DataFrame, text: str = "text", max_symbols: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Add the word ids of raw sentences and the sentence rewritten with unknown words replaced."""
    encoded = encode(with_tokens(sentences, "word", text), vocab, corpus_rule=False, max_symbols=max_symbols)
    rewritten = F.zip_with(
        "tokens", "ids", lambda token, id_: F.when(id_ == UNK, F.lit("<UNK>")).otherwise(token)
    )
    return encoded.withColumn("sentence", F.array_join(rewritten, " "))


def decode(
    docs: DataFrame, vocab: DataFrame, ids: str = "ids", out: str = "text", max_symbols: int = MAX_LITERAL_VALUES
) -> DataFrame:
    """Add the symbols of an id array, joined by blanks; ids without a symbol are left out, and a null
    array gives ``''``. Up to ``max_symbols`` ids are places in a constant array, more are joined."""
    rows = bounded_rows(vocab.select("id", "symbol"), max_symbols)
    if rows is None:
        return decode_by_join(docs, vocab, ids, out)
    by_id = {row["id"]: row["symbol"] for row in rows}
    symbols = arrays.literal_array(
        [by_id.get(i) for i in range(max(by_id, default=-1) + 1)], "array<string>"
    )
    text = F.array_join(F.transform(ids, lambda i: F.get(symbols, i)), " ")
    return docs.withColumn(out, F.coalesce(text, F.lit("")))


def decode_by_join(docs: DataFrame, vocab: DataFrame, ids: str = "ids", out: str = "text") -> DataFrame:
    """Same result as ``decode`` for a vocabulary of any size."""
    docs = with_row_number(docs, "_row")
    flat = unnest(docs, ["_row"], F.col(ids), "pos", "id")
    found = skew_safe_lookup(flat, vocab.select("id", "symbol"), "id")
    text = found.groupBy("_row").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("pos", "symbol"))), lambda p: p["symbol"]
            ),
            " ",
        ).alias(out)
    )
    return docs.join(text, "_row", "left").withColumn(out, F.coalesce(out, F.lit(""))).drop("_row")


def vocab_summary(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """One row: symbols seen and removed, vocabulary size, largest id, unknown token share."""
    known = vocab.filter("kept")
    totals = counts.agg(
        F.count(F.lit(1)).alias("symbols_seen"), F.sum("n").alias("tokens_seen")
    )
    kept = known.agg(F.count(F.lit(1)).alias("symbols_kept"), F.sum("n").alias("tokens_kept"))
    sizes = vocab.agg(
        F.count(F.lit(1)).alias("vocab_size"), F.max("id").cast("long").alias("last_id")
    )
    # Three one-row tables side by side.
    side_by_side = totals.withColumn("_one", F.lit(1))
    for other in (kept, sizes):
        side_by_side = side_by_side.join(F.broadcast(other.withColumn("_one", F.lit(1))), "_one")
    return side_by_side.select(
        "symbols_seen",
        (F.col("symbols_seen") - F.col("symbols_kept")).alias("symbols_removed"),
        "vocab_size",
        "last_id",
        (1 - F.col("tokens_kept") / F.col("tokens_seen")).alias("oov_rate"),
    )


def split_train_test(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two filters; everything that is not train is test."""
    train = F.col("split") == "train"
    return docs.filter(train), docs.filter(~F.coalesce(train, F.lit(False)))


def length_stats(docs: DataFrame, values: str | Column = "tokens") -> DataFrame:
    """Mean, population deviation, longest and shortest array length."""
    size = F.size(values)
    return docs.agg(
        F.avg(size).alias("mean_len"),
        F.stddev_pop(size).alias("sd_len"),
        F.max(size).cast("long").alias("max_len"),
        F.min(size).cast("long").alias("min_len"),
    )


def special_loss(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """How many number, stop and mark symbols a second pass of the tokeniser would spoil.

    Tokenising joined tokens again folds ``<NUMBER>`` to ``<number>``, which no
    vocabulary holds. Data-quality check for texts that were tokenised before.
    """
    again = tokeniser("word")(F.array_join(tokens, " "))
    marks = ["<NUMBER>", "<STOP>", "<PUNCT>"]

    def count(column, symbols):
        return F.sum(F.size(F.filter(column, lambda t: t.isin(*symbols)))).cast("long")

    return docs.agg(
        count(F.col(tokens), marks).alias("specials_once"),
        count(again, marks).alias("specials_twice"),
        count(again, [m.lower() for m in marks]).alias("specials_spoiled"),
    )
