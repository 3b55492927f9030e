"""How far the sources of a language differ in their words, by triangular divergence of smoothed shares.

Identical texts of a language are collapsed to one with its number per source, tokenised once and added
with these weights. Shares are whole numbers, parts of ``SCALE``; all arithmetic is exact. Pairs of
sources are summed over the terms that both have; a term that one or neither has adds a value that
depends on the other's share only, and is added from each source's histogram of shares.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from doclens.llm.common import read, ships
from doclens.session import written

ships(__name__)

SCALE = 1_000_000_000
# Entries a task counts before it hands them on, bytes of distinct texts it holds, source pairs it compares
# at a time.
HELD, TEXTS, PAIRS = 400_000, 16 << 20, 1 << 18
# Bytes of a term are ASCII letters, in lower case, and all bytes of other characters; the rest are blanks.
_TERM = bytes(
    b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


def _lists(sizes: list[int] | np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values)


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a task with their number per source, each text once as long as it is held; compressed."""
    held: dict[tuple, Counter] = {}
    size, names = 0, ["lang", "digest", "body", "sources", "times"]
    squeeze = zstandard.ZstdCompressor(level=1)

    def made() -> pa.RecordBatch:
        sizes = [len(c) for c in held.values()]
        columns = [
            pa.array([lang for lang, _ in held], pa.string()),
            pa.array([xxh3_128_digest(text) for _, text in held], pa.binary()),
            pa.array([squeeze.compress(text) for _, text in held], pa.binary()),
            _lists(sizes, pa.array([s for c in held.values() for s in c], pa.string())),
            _lists(sizes, pa.array([n for c in held.values() for n in c.values()], pa.int64())),
        ]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns[:2]), texts, strict=True):
            body = text.as_py()
            if (lang, body) not in held:
                held[lang, body] = Counter()
                size += len(body) + 100
            held[lang, body][source] += 1
            if size >= TEXTS:
                yield made()
                size = 0
    if held:
        yield made()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, df, sources, ns): weighted counts of the terms of a task. Equal texts follow each other;
    their numbers per source are added, then the text is tokenised, once."""
    counts: dict[tuple, Counter] = defaultdict(Counter)
    found: dict[str, Counter] = defaultdict(Counter)
    expand = zstandard.ZstdDecompressor()
    held = 0

    def add(lang: str, body: bytes, sources: Counter) -> None:
        nonlocal held
        words = Counter(terms(expand.decompress(body)))
        weight = sources.total()
        found[lang].update(dict.fromkeys(words, weight))
        for source, times in sources.items():
            counter = counts[lang, source]
            before = len(counter)
            counter.update(words if times == 1 else {t: n * times for t, n in words.items()})
            held += len(counter) - before

    def made() -> Iterator[pa.RecordBatch]:
        nonlocal held
        for lang, documents in found.items():
            groups = [(source, counter) for (of, source), counter in counts.items() if of == lang and counter]
            if not groups:
                continue
            every = pa.array([t for _, counter in groups for t in counter], pa.binary()).dictionary_encode()
            codes = every.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            source = np.repeat(np.arange(len(groups)), [len(counter) for _, counter in groups])[order]
            n = np.fromiter((n for _, counter in groups for n in counter.values()), np.int64, len(codes))[order]
            words = every.dictionary.to_pylist()
            sizes = np.bincount(codes, minlength=len(words))
            names = pa.array([s for s, _ in groups], pa.string()).take(pa.array(source))
            columns = [
                pa.array([lang], pa.string()).take(pa.array(np.zeros(len(words), np.int32))), every.dictionary.cast(pa.string()),
                pa.array([documents[t] for t in words], pa.int64()), _lists(sizes, names), _lists(sizes, pa.array(n)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "term", "df", "sources", "ns"])
        counts.clear()
        found.clear()
        held = 0

    now, sources = None, Counter()
    for batch in batches:
        for lang, body, names, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lang, body) != now:
                if now is not None:
                    add(*now, sources)
                    if held >= HELD:
                        yield from made()
                now, sources = (lang, body), Counter()
            sources.update(dict(zip(names, times, strict=True)))
    if now is not None:
        add(*now, sources)
    yield from made()


def _merged(rows: pa.Table, run: np.ndarray) -> pa.Table:
    """Rows of one term and language added up; ``run`` numbers them, in order, from 0."""
    firsts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    lists, ns = rows["sources"].combine_chunks(), rows["ns"].combine_chunks()
    every = lists.flatten().dictionary_encode()
    names = max(1, len(every.dictionary))
    sizes = pc.list_value_length(lists).to_numpy()
    key = np.repeat(run, sizes) * names + every.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.add.reduceat(ns.flatten().to_numpy()[order], starts)
    lengths = np.bincount(key[starts] // names, minlength=len(firsts))
    sources = every.dictionary.take(pa.array(key[starts] % names))
    df = np.add.reduceat(rows["df"].to_numpy(), firsts)
    at = pa.array(firsts)
    return pa.table([
        rows["lang"].combine_chunks().take(at), rows["term"].combine_chunks().take(at), pa.array(df),
        _lists(lengths, sources), _lists(lengths, pa.array(n)),
    ], ["lang", "term", "df", "sources", "ns"])


def _kept(least: int):
    """The terms of at least so many documents, from rows in order of language and term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if last is None else pa.concat_tables([last, rows])
            lang, term = rows["lang"].combine_chunks(), rows["term"].combine_chunks()
            differ = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(term[1:], term[:-1]))
            number = np.cumsum(np.r_[0, differ.to_numpy(zero_copy_only=False)])
            # The last term may go on in the next batch; it is one row until then.
            cut = int(np.searchsorted(number, number[-1]))
            last = _merged(rows.slice(cut), number[cut:] - number[-1])
            if cut:
                total = np.add.reduceat(rows["df"].to_numpy()[:cut], np.flatnonzero(np.diff(number[:cut], prepend=-1)))
                chosen = np.flatnonzero((total >= least)[number[:cut]])
                if len(chosen):
                    runs = np.unique(number[chosen], return_inverse=True)[1]
                    yield from _merged(rows.take(pa.array(chosen)), runs).to_batches()
        if last is not None and last["df"][0].as_py() >= least:
            yield from last.to_batches()

    return run


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 kept)), exact for any counts; null without kept terms."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(19,0)")
    down = (total + 2 * kept).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", up, down))


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares fit 30 bits, so squares fit a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over the terms that two sources have: the sum of their gap, less the values that the histograms add
    for either term, and more what they take off twice. Rows (lang, ids, shares, shares of no occurrence)
    by term; the pairs of a task are added up before they go on, ``PAIRS`` at a time."""

    def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // (p + q)

    def added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[starts], np.add.reduceat(values, starts)

    def out(lang: str, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([lang] * len(keys), pa.string()), pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(values)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "value"])

    now, held = None, 0
    keys: list[np.ndarray] = []
    values: list[np.ndarray] = []
    for batch in batches:
        lists = [c.flatten().to_numpy() for c in batch.columns[1:]]
        sizes = batch.column(1).value_lengths().to_numpy()
        starts = np.cumsum(sizes) - sizes
        for lang, start, size in zip(batch.column(0).to_pylist(), starts.tolist(), sizes.tolist(), strict=True):
            if lang != now and keys:
                yield out(now, *added(np.concatenate(keys), np.concatenate(values)))
                keys, values, held = [], [], 0
            now = lang
            source, p, p0 = (column[start : start + size] for column in lists)
            step = max(1, PAIRS // size)
            for at in range(0, size, step):
                rows = np.arange(at, min(size, at + step))
                i, j = np.nonzero(rows[:, None] < np.arange(size)[None, :])
                if not len(i):
                    continue
                i = rows[i]
                keys.append(source[i] << 32 | source[j])
                values.append(gaps(p[i], p[j]) - gaps(p[i], p0[j]) - gaps(p0[i], p[j]) + gaps(p0[i], p0[j]))
                held += len(i)
                if held < PAIRS:
                    continue
                merged = added(np.concatenate(keys), np.concatenate(values))
                if len(merged[0]) > PAIRS // 2:
                    yield out(now, *merged)
                    keys, values, held = [], [], 0
                else:
                    keys, values, held = [merged[0]], [merged[1]], len(merged[0])
    if held:
        yield out(now, *added(np.concatenate(keys), np.concatenate(values)))


def term_counts(docs: DataFrame, least: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, term, df, sources, ns) of the terms in ``least`` documents of a language, with their number
    per source in two lists.

    Texts are shuffled once, by a hash of language and text, after equal ones of a task became one; a
    text on a third of all rows is a few rows per task. Terms are shuffled once, by term, after those of
    a task were added up; a term is added up in one task, from a row per task."""
    names = ((lang, "lang"), (source, "source"), (text, "text"))
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in names])
    schema = "lang string, digest binary, body binary, sources array<string>, times array<bigint>"
    texts = rows.mapInArrow(_collapse, schema).repartition("lang", "digest").sortWithinPartitions("lang", "digest", "body")
    counted = texts.drop("digest").mapInArrow(_count, "lang string, term string, df bigint, sources array<string>, ns array<bigint>")
    by_term = counted.repartition("lang", "term").sortWithinPartitions("lang", "term")
    return by_term.mapInArrow(_kept(least), counted.schema)


def divergence(
    docs: DataFrame, least: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text"
) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source differs from the others of its language.

    Terms are runs of ASCII letters, in lower case, and of other characters from U+0080 on. A language
    keeps the terms of ``least`` of its documents. Shares are smoothed by two occurrences, see ``share``.
    Part ``pair``: the other sources of the language, with the sum of ``gap`` over all kept terms, 0
    where there are none. Part ``term``: the ``top`` kept terms of the source whose share is above the
    language's, by gap. Rank 1 is the largest value, equal ones by item in UTF-8 order.

    Counts are spread over terms, not over languages, see ``term_counts``. The sources of a term, and the
    histogram of a source's shares, are lists in one row: as long as there are sources, or different
    counts. Pairs are dealt over tasks by their first source. Null text, language and source are ''. Repeated rows count
    each. Empty in, empty out; other columns are not read.
    """
    spark = docs.sparkSession
    kept = term_counts(docs, least, lang, source, text).withColumn("t", F.monotonically_increasing_id())
    whole = F.aggregate("ns", F.lit(0).cast("bigint"), lambda total, n: total + n)
    kept = written(kept.withColumn("whole", whole), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("whole").alias("all"))
    inside = kept.select("lang", "t", "term", "whole", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("ns").alias("n"))))
    totals = inside.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    groups = docs.select(*names).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select(
        "lang", "source", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"),
        F.coalesce("kept", F.lit(0).cast("bigint")).alias("kept"), F.coalesce("all", F.lit(0).cast("bigint")).alias("all"),
    )
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("bigint")
    groups = groups.withColumn("id", number).withColumn("none", share(F.lit(0).cast("bigint"), F.col("total"), F.col("kept")))
    groups = written(groups, "groups")

    shares = inside.join(groups, ["lang", "source"]).select(
        "lang", "source", "id", "none", "t", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        share(F.col("whole"), F.col("all"), F.col("kept")).alias("q"),
    )
    above = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    words = above.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)

    lists = F.sort_array(F.collect_list(F.struct("id", "p", "none"))).alias("_at")
    by_term = shares.groupBy("lang", "t").agg(lists).filter(F.size("_at") > 1)
    by_term = by_term.select("lang", "_at.id", "_at.p", "_at.none").sortWithinPartitions("lang")
    both = by_term.mapInArrow(_common, "lang string, a bigint, b bigint, value bigint")
    both = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("both"))

    histogram = shares.groupBy("lang", "id", "p").agg(F.count(F.lit(1)).alias("terms"))
    histogram = histogram.groupBy("lang", "id").agg(F.collect_list(F.struct("p", "terms")).alias("shares"))
    # Pairs of a language are dealt by the first source, and the second source to all of its deals.
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sources = groups.join(histogram, ["lang", "id"], "left")
    one = sources.select("lang", "source", F.col("id").alias("a"), F.col("none").alias("_p0"), F.col("shares").alias("_p"), "kept")
    other = sources.select("lang", F.col("source").alias("item"), F.col("id").alias("b"), F.col("none").alias("_q0"))
    other = other.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    pairs = one.withColumn("_deal", F.pmod(F.xxhash64("a"), F.lit(deals)).cast("int")).join(other, ["lang", "_deal"])
    pairs = pairs.filter(F.col("a") != F.col("b"))
    base = gap(F.col("_p0"), F.col("_q0"))
    own = F.aggregate(
        F.coalesce("_p", F.array().cast("array<struct<p:bigint,terms:bigint>>")), F.lit(0).cast("bigint"),
        lambda total, s: total + s["terms"] * (gap(s["p"], F.col("_q0")) - base),
    )
    sided = written(pairs.select("lang", "source", "item", "a", "b", own.alias("own"), (F.col("kept") * base).alias("rest")), "sides")
    back = sided.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("own").alias("back"))
    both = both.unionByName(both.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), "both"))
    value = F.col("own") + F.col("back") + F.col("rest") + F.coalesce("both", F.lit(0).cast("bigint"))
    whole = sided.join(back, ["lang", "a", "b"]).join(both, ["lang", "a", "b"], "left")
    whole = whole.select("lang", "source", "item", F.coalesce(value, F.lit(0).cast("bigint")).alias("value"))
    apart = whole.withColumn("rank", F.row_number().over(by_value))
    return apart.withColumn("part", F.lit("pair")).unionByName(words.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank"
    )


def query(spark: SparkSession, sf: str) -> DataFrame:
    return divergence(read(spark, sf, "documents", "lang", "source", "text"))


SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
flat AS (SELECT row_no, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS whole FROM flat GROUP BY lang, term HAVING count(DISTINCT row_no) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(whole)::BIGINT AS n FROM kept GROUP BY lang),
counts AS (SELECT f.lang, f.source, f.term, count(*) AS n FROM flat f JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n)::BIGINT AS n FROM counts GROUP BY ALL),
sources AS (SELECT DISTINCT lang, source FROM docs),
shares AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
    (1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(t.n, 0) + 2 * l.v))::BIGINT AS p,
    (1 + {SCALE}::HUGEINT * (k.whole + 2) // (l.n + 2 * l.v))::BIGINT AS q
  FROM sources s JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t USING (lang, source)
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
words AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
  FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM words))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
