"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. DataFrame functions only.

A sketch is a list of strata, each three tables of cells. A digest belongs to the stratum of its low bits
and to one cell of each table; a cell holds the number of its digests, their XOR and the XOR of their
checks. The number of strata is a power of two that grows with the number of paragraphs, so sketches of any
two texts can be brought to one size (``folded``), subtracted and peeled, which gives the digests that only
one of them has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import let, read
from doclens.operators.numbering import row_numbers
from doclens.session import written

# Cells in each of the three tables of a stratum; a fingerprint has the first, after a failure the next is tried.
WIDTHS = (4, 8, 16, 32, 64)
CELLS = 3 * WIDTHS[0]
# Paragraphs that a stratum of a fingerprint holds, three to six of them.
STRATUM = 6
# A line is cut after one word in so many, chosen by the word's hash, and a longer word into runs of so many characters.
CUT_WORDS, CUT_RUN = 16, 64
ROUNDS = 12
# Hexadecimal digits of a cell as text: count, XOR of digests, XOR of checks.
_COUNT, _DIGEST, _CHECK = 4, 16, 8
_CELL = _COUNT + _DIGEST + _CHECK
_NONE = "array<bigint>"


def paragraphs(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text: its lines, long ones cut by their own content.

    A line is cut after each word (what single spaces part) whose hash is a multiple of 16, so an edit moves
    no cut beyond the words it touches. A word of over 64 characters, as scripts without spaces and encoded
    data have, is cut at white space, after full stops, exclamation and question marks of such scripts, and
    after 64 characters without any. Spaces at the ends of a paragraph do not count, empty ones are none.
    """

    def mark(word: Column) -> Column:
        runs = F.regexp_replace(word, f"[^\\s。！？]{{1,{CUT_RUN}}}[。！？]*", "$0\n")
        chosen = F.pmod(F.xxhash64(word), F.lit(CUT_WORDS)) == 0
        return F.when(F.length(word) > CUT_RUN, runs).when(chosen, F.concat(word, F.lit("\n"))).otherwise(word)

    marked = F.array_join(F.transform(F.split(text, " "), lambda word: mark(word)), " ")
    pieces = F.filter(F.transform(F.split(marked, "\n"), lambda piece: F.trim(piece)), lambda piece: piece != "")
    return F.array_distinct(F.transform(pieces, lambda piece: F.xxhash64(piece)))


def _check(x: Column) -> Column:
    return F.xxhash64(x, F.lit("check")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def _places(items: Column, width: Column) -> Column:
    """Items (n, x, c) with their cell in each of the three tables."""

    def place(x: Column, table: int) -> Column:
        return (F.pmod(F.xxhash64(x, F.lit(table)), width) + width * table).cast("int")

    return F.transform(
        items,
        lambda i: F.struct(
            i["n"].alias("n"), i["x"].alias("x"), i["c"].alias("c"), *[place(i["x"], t).alias(f"p{t}") for t in range(3)]
        ),
    )


def _in_cell(items: Column, j: Column) -> Column:
    return F.filter(items, lambda i: (i["p0"] == j) | (i["p1"] == j) | (i["p2"] == j))


def _cell(n: Column, x: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), x.alias("x"), c.alias("c"))


def _plus(a: Column, b: Column) -> Column:
    return _cell(a["n"] + b["n"], a["x"].bitwiseXOR(b["x"]), a["c"].bitwiseXOR(b["c"]))


def _minus(a: Column, b: Column) -> Column:
    return _cell(a["n"] - b["n"], a["x"].bitwiseXOR(b["x"]), a["c"].bitwiseXOR(b["c"]))


def _upto(count: Column) -> Column:
    return F.sequence(F.lit(0), count - 1)


def strata_count(n: Column) -> Column:
    """How many strata ``n`` paragraphs have: the least power of two that leaves each at most six on average."""
    most = F.greatest(F.lit(1), F.ceil(n / STRATUM)).cast("bigint")
    return F.call_function("shiftleft", F.lit(1), F.when(most > 1, F.length(F.bin(most - 1))).otherwise(0))


def strata(digests: Column, count: Column) -> Column:
    """The digests of each stratum, the one of remainder s at place s.

    They are parted by some of the low bits, then each part by the rest: n^1.5 steps for n digests."""
    bits = F.length(F.bin(count)) - 1
    first = F.floor(bits / 2).cast("int")
    one = F.lit(1)
    known = F.struct(digests.alias("digests"), count.alias("count"), first.alias("first"), (bits - first).alias("rest"))

    def part(of: Column, key, ways: Column) -> Column:
        return F.transform(_upto(ways), lambda g: F.filter(of, lambda x: F.pmod(key(x), ways) == g))

    def deal(k: Column) -> Column:
        wide, narrow = k["wide"], k["narrow"]
        coarse = part(k["digests"], lambda x: x, wide)
        fine = F.transform(coarse, lambda p: part(p, lambda x: F.call_function("shiftright", x, k["first"]), narrow))

        def place(s: Column) -> Column:
            return (F.pmod(s, wide) * narrow + F.call_function("shiftright", s, k["first"])).cast("int")

        return let(F.flatten(fine), lambda flat: F.transform(_upto(k["count"]), lambda s: F.get(flat, place(s))))

    def ways(k: Column) -> Column:
        wide, narrow = (F.call_function("shiftleft", one, k[name]) for name in ("first", "rest"))
        return F.struct(
            k["digests"].alias("digests"), k["count"].alias("count"), k["first"].alias("first"),
            wide.alias("wide"), narrow.alias("narrow"),
        )

    return let(let(known, ways), deal)


def cells(digests: Column, width: Column) -> Column:
    """Cells of one stratum: three tables of ``width`` cells."""
    items = F.transform(digests, lambda x: _cell(F.lit(1), x, _check(x)))
    zero = _cell(F.lit(0), F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    return let(
        _places(items, width),
        lambda p: F.transform(_upto(width * 3), lambda j: F.aggregate(_in_cell(p, j), zero, _plus)),
    )


def sketch(parts: Column) -> Column:
    """The cells of each stratum, as a fingerprint has them."""
    return F.transform(parts, lambda digests: cells(digests, F.lit(WIDTHS[0])))


def fingerprint(digests: Column) -> Column:
    """The sketch of a text's paragraphs, with as many strata as their number asks for."""
    return let(digests, lambda d: sketch(strata(d, strata_count(F.size(d)))))


def folded(sketched: Column, count: Column) -> Column:
    """The same sketch with fewer strata, both powers of two: those of one remainder are added."""
    empty = F.lit(None).cast("array<struct<n:int,x:bigint,c:bigint>>")

    def add(total: Column, more: Column) -> Column:
        return F.when(total.isNull(), more).otherwise(F.zip_with(total, more, _plus))

    def gather(g: Column) -> Column:
        return F.aggregate(F.filter(sketched, lambda _, s: F.pmod(s, count) == g), empty, add)

    return F.transform(_upto(count), gather)


def peeled(left: Column, width: Column) -> Column:
    """The digests in the difference of two strata: an array of one (gone, new), or none if it does not
    come apart. Round by round, the digests that stand alone in a cell, as its check shows, are taken out."""

    def take(state: Column, _: Column) -> Column:
        alone = F.filter(
            state["cells"], lambda c: ((c["n"] == 1) | (c["n"] == -1)) & (_check(c["x"]) == c["c"])
        )

        def of(pure: Column, sign: int) -> Column:
            return F.transform(F.filter(pure, lambda p: p["n"] == sign), lambda p: p["x"])

        def remove(pure: Column) -> Column:
            return F.struct(
                F.transform(state["cells"], lambda c, j: F.aggregate(_in_cell(pure, j), c, _minus)).alias("cells"),
                F.concat(state["gone"], of(pure, 1)).alias("gone"),
                F.concat(state["new"], of(pure, -1)).alias("new"),
            )

        return let(_places(F.array_distinct(alone), width), lambda p: F.when(F.size(p) == 0, state).otherwise(remove(p)))

    start = F.struct(left.alias("cells"), F.array().cast(_NONE).alias("gone"), F.array().cast(_NONE).alias("new"))
    done = F.array(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, take))
    whole = F.filter(done, lambda s: F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["x"] == 0) & (c["c"] == 0)))
    return F.transform(whole, lambda s: F.struct(s["gone"].alias("gone"), s["new"].alias("new")))


def _united(found: Column) -> Column:
    """One (gone, new) of those of all strata."""
    gone, new = F.transform(found, lambda s: s["gone"]), F.transform(found, lambda s: s["new"])
    return F.struct(F.flatten(gone).alias("gone"), F.flatten(new).alias("new"))


def difference(a: Column, b: Column) -> Column:
    """(gone, new) from two sketches alone, of any number of strata; null if a stratum does not come apart."""

    def left(k: Column) -> Column:
        pairs = F.zip_with(folded(k["a"], k["count"]), folded(k["b"], k["count"]), lambda x, y: F.zip_with(x, y, _minus))
        return F.transform(pairs, lambda cells_: peeled(cells_, F.lit(WIDTHS[0])))

    both = F.struct(a.alias("a"), b.alias("b"))
    sized = let(both, lambda k: F.struct(k["a"].alias("a"), k["b"].alias("b"), F.least(F.size(k["a"]), F.size(k["b"])).alias("count")))
    return let(let(sized, left), lambda f: F.when(F.forall(f, lambda s: F.size(s) == 1), _united(F.flatten(f))))


def _stratum(pair: Column) -> Column:
    """An array of one (gone, new) of a stratum whose digests are at hand: first by the two sketches, and
    on failure by larger ones; digest by digest where no size comes apart."""

    def attempt(state: Column, width: Column) -> Column:
        larger = F.zip_with(cells(pair["a"], width), cells(pair["b"], width), _minus)
        return F.when(F.size(state) > 0, state).otherwise(peeled(larger, width))

    first = peeled(F.zip_with(pair["cells_a"], pair["cells_b"], _minus), F.lit(WIDTHS[0]))
    tried = F.aggregate(F.array(*[F.lit(w) for w in WIDTHS[1:]]), first, attempt)
    exact = F.array(
        F.struct(
            F.array_except(pair["a"], pair["b"]).alias("gone"), F.array_except(pair["b"], pair["a"]).alias("new")
        )
    )
    return let(tried, lambda t: F.when(F.size(t) > 0, t).otherwise(exact))


def with_differences(df: DataFrame, a: str, b: str, gone: str, new: str, sketches: dict[str, str] | None = None) -> DataFrame:
    """Add ``gone`` and ``new``: the paragraph digests that only ``a``, only ``b`` has, as peeling recovers them.

    ``sketches`` names the columns that hold the sketch of ``a`` or ``b`` already: they are subtracted as they
    are where both have as many strata, else the smaller one is made again with those of the larger.
    """
    kept, have = df.columns, sketches or {}
    df = df.withColumn("_count", strata_count(F.greatest(F.size(a), F.size(b))))
    for name, side in ((a, "_sa"), (b, "_sb")):
        df = df.withColumn(side, strata(F.col(name), F.col("_count")))
    for name, side, made in ((a, "_sa", "_ca"), (b, "_sb", "_cb")):
        again = sketch(F.col(side))
        if name in have:
            again = F.when(F.size(have[name]) == F.col("_count"), F.col(have[name])).otherwise(again)
        df = df.withColumn(made, again)
    names = {"_sa": "a", "_sb": "b", "_ca": "cells_a", "_cb": "cells_b"}
    pairs = F.arrays_zip(*names)

    def stratum(p: Column) -> Column:
        return let(F.struct(*[p[old].alias(name) for old, name in names.items()]), _stratum)

    df = df.withColumn("_found", F.flatten(F.transform(pairs, stratum)))
    return df.withColumn("_all", _united(F.col("_found"))).select(
        *kept, F.col("_all.gone").alias(gone), F.col("_all.new").alias(new)
    )


def likeness(n_a: Column, n_b: Column, gone: Column, new: Column) -> Column:
    """Common paragraphs over the mean number of both texts, from what was peeled; 1 if both have none."""
    common = n_a - F.size(gone) + n_b - F.size(new)
    return F.when(n_a + n_b == 0, F.lit(1.0)).otherwise(common / (n_a + n_b))


def text_form(sketched: Column) -> Column:
    """A sketch as text, cell by cell: 2 bytes of count, 8 of the XOR of digests, 4 of that of checks, in base64."""

    def digits(c: Column) -> Column:
        count = F.lpad(F.hex(c["n"].bitwiseAND(F.lit(0xFFFF))), _COUNT, "0")
        return F.concat(count, F.lpad(F.hex(c["x"]), _DIGEST, "0"), F.lpad(F.hex(c["c"]), _CHECK, "0"))

    stratum = F.transform(sketched, lambda s: F.array_join(F.transform(s, digits), ""))
    return F.base64(F.unhex(F.array_join(stratum, "")))


def from_text(form: Column) -> Column:
    """The sketch that ``text_form`` wrote."""

    def number(digits: Column, at: int, length: int) -> Column:
        return F.conv(F.substring(digits, at, length), 16, -10).cast("bigint")

    def cell(digits: Column) -> Column:
        return _cell(
            number(digits, 1, _COUNT),
            number(digits, 1 + _COUNT, _DIGEST),
            number(digits, 1 + _COUNT + _DIGEST, _CHECK),
        )

    digits = F.regexp_replace(F.hex(F.unbase64(form)), "\\s", "")
    parts = F.regexp_extract_all(digits, F.lit(f".{{{_CELL * CELLS}}}"), F.lit(0))
    return F.transform(
        parts, lambda s: F.transform(F.regexp_extract_all(s, F.lit(f".{{{_CELL}}}"), F.lit(0)), cell)
    )


def next_ids(ids: DataFrame, key: str) -> DataFrame:
    """(key, next) over distinct keys in descending order; after the last comes the first.

    Keys are numbered by ranges (``row_numbers``), so the whole order never meets in one task."""
    order = written(row_numbers(ids, [F.col(key).desc()], out="place").select(key, "place"), "order")
    count = max(1, order.count())
    follower = order.select(F.col(key).alias("next"), "place")
    return order.withColumn("place", F.col("place") % count + 1).join(follower, "place").drop("place")


def edited_versions(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text with an edited version: the last third of its characters is replaced by as many from
    the start of the next document, in descending order of keys.

    Gives key, ``text`` (null: empty), ``edited`` and ``next_digests`` (paragraphs of the next text).
    Texts are shuffled by key once, for both joins; to the edited document go only the leading third
    and the digests of the next one.

    Of rows with one key, the next document is the one with the lowest leading text; each of them is
    edited. A row whose key is null has no place in the order: its next document is empty.
    """
    body = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = body.filter(F.col(key).isNotNull())
    sizes = keyed.groupBy(key).agg(F.max(F.floor(F.length("text") / 3)).alias("most"))
    sizes = written(sizes, "sizes")
    chain = next_ids(sizes.select(key), key).join(sizes, key).withColumnRenamed(key, "_for").withColumnRenamed("next", key)
    heads = keyed.join(chain, key).select(
        F.col("_for").alias(key),
        F.struct(
            F.expr("substring(text, 1, cast(most as int))").alias("head"), paragraphs(F.col("text")).alias("digests")
        ).alias("_next"),
    )
    heads = heads.groupBy(key).agg(F.min("_next").alias("_next"))
    cut = F.floor(F.length("text") / 3).cast("int")

    def edit(rows: DataFrame, head: Column, digests: Column) -> DataFrame:
        kept = F.col("text").substr(F.lit(1), F.length("text") - cut)
        return rows.select(
            key, "text", F.concat(kept, head.substr(F.lit(1), cut)).alias("edited"), digests.alias("next_digests")
        )

    alone = body.filter(F.col(key).isNull())
    joined = edit(keyed.join(heads, key), F.col("_next.head"), F.col("_next.digests"))
    return joined.unionByName(edit(alone, F.lit(""), F.array().cast("array<bigint>")))


def compare_versions(versions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Fingerprints of text and edited text, how like they are (see ``likeness``), and the digests in which
    they differ: ``gone`` (only the text has them) and ``new`` (only the edited text), ascending.

    Texts without a paragraph have a sketch of empty cells. Equal texts have equal fingerprints.
    """
    marked = versions.select(
        key,
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        paragraphs(F.col("text")).alias("_a"),
        paragraphs(F.col("edited")).alias("_b"),
        F.col("next_digests").alias("_c"),
    )
    for digests, made in (("_a", "_fa"), ("_b", "_fb")):
        marked = marked.withColumn(made, fingerprint(F.col(digests)))
    compared = with_differences(marked, "_a", "_b", "gone", "new", {"_a": "_fa", "_b": "_fb"})
    compared = with_differences(compared, "_a", "_c", "_gone", "_new", {"_a": "_fa"})
    sizes = [F.size(name) for name in ("_a", "_b", "_c")]
    return compared.select(
        key, "n_chars", "edited_sha256",
        text_form(F.col("_fa")).alias("fingerprint"),
        text_form(F.col("_fb")).alias("edited_fingerprint"),
        likeness(sizes[0], sizes[1], F.col("gone"), F.col("new")).alias("near_edited"),
        likeness(sizes[0], sizes[2], F.col("_gone"), F.col("_new")).alias("near_next"),
        F.array_sort("gone").alias("gone"),
        F.array_sort("new").alias("new"),
    )


def query(spark: SparkSession, sf: str) -> DataFrame:
    compared = compare_versions(edited_versions(read(spark, sf, "documents", "doc_id", "text")))
    listed = {c: F.array_join(F.transform(c, lambda x: F.lower(F.lpad(F.hex(x), _DIGEST, "0"))), " ") for c in ("gone", "new")}
    return compared.withColumns(listed)
