"""Benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.llm.common import read, ships

ships(__name__)

# Scripts written without spaces: Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff"
_UNSPACED += "\uf900-\ufaff\uff66-\uff9f\U00020000-\U000323af"
WORDS = re.compile(rf"[^\W_{_UNSPACED}]+|(?=[^\W_])[{_UNSPACED}]")
_CHARACTER = re.compile(f"[{_UNSPACED}]")
WIDTH = 5
# Words of the shortest item that is looked for as a whole; a character of an unspaced script is half a word.
LEAST = 3
# Items, and bytes of their texts, in one broadcast index; more are searched in blocks, each one pass over the documents.
BLOCK, BLOCK_BYTES = 200_000, 1 << 26
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case; of scripts without spaces each character."""
    return WORDS.findall((text or "").lower())


def searched(found: list[str], width: int, short: bool) -> int:
    """Words in a shingle of an item with these words: ``width``, with ``short`` all words of a shorter
    item; 0 for an item that is not looked for, as clean documents hold it too."""
    if len(found) >= width:
        return width
    weight = sum(0.5 if _CHARACTER.match(word) else 1.0 for word in found)
    return len(found) if short and weight >= LEAST else 0


def shingle_codes(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit code for each run of ``width`` word numbers."""
    n = max(0, len(ids) - width + 1)
    code = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            code = (code ^ ids[j : j + n].astype(np.uint64)) * _MULTIPLIER
            code ^= code >> np.uint64(29)
    return code


class Index:
    """Items by size class, each with the bottom MinHash values of its distinct shingles.

    An item of n distinct shingles that is contained to ``threshold`` lacks at most
    n - ceil(threshold n) of them in the document, so of its n - ceil(threshold n) + 1 smallest
    hash values one at least is the document's. That sketch size is set per size class, from the
    largest item in it: large enough for each member, and no true item is missed.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float, width: int, short: bool = False):
        self.threshold = threshold
        self.widths: set[int] = set()
        self.vocabulary: dict[str, int] = {}
        self.items: dict[int, np.ndarray] = {}
        classes: dict[int, list[int]] = {}
        for place, (_, text) in enumerate(items):
            said = words(text)
            run = searched(said, width, short)
            if run:
                self.widths.add(run)
                numbers = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in said]
                codes = np.unique(shingle_codes(np.array(numbers, np.int64), run))
                self.items[place] = codes
                classes.setdefault(len(codes).bit_length(), []).append(place)
        self.names = [key for key, _ in items]
        sketch: dict[int, list[int]] = {}
        for members in classes.values():
            largest = max(len(self.items[m]) for m in members)
            size = largest - ceil(threshold * largest - 1e-9) + 1
            for m in members:
                for code in self.items[m][:size].tolist():
                    sketch.setdefault(code, []).append(m)
        self.keys = np.array(sorted(sketch), np.uint64)
        self.owners = [sketch[code] for code in self.keys.tolist()]

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, shared, distinct shingles) of each item contained in the text."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words(text)], np.int64)
        known = ids > 0
        made = [np.zeros(0, np.uint64)]
        for width in self.widths:
            # Only runs of benchmark words can make a shingle of an item.
            together = np.convolve(known, np.ones(width, np.int8), "valid") if len(ids) >= width else []
            made.append(shingle_codes(ids, width)[np.asarray(together) == width])
        codes = np.concatenate(made)
        if not len(codes) or not len(self.keys):
            return []
        codes = np.unique(codes)
        at = np.minimum(np.searchsorted(self.keys, codes), len(self.keys) - 1)
        hits = at[self.keys[at] == codes]
        found = []
        for item in sorted({m for h in hits.tolist() for m in self.owners[h]}):
            mine = self.items[item]
            shared = int(np.isin(mine, codes, assume_unique=True).sum())
            if shared >= self.threshold * len(mine) - 1e-9:
                found.append((item, shared, len(mine)))
        return found


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.8,
    width: int = WIDTH,
    key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    block: int = BLOCK,
    short: bool = False,
) -> DataFrame:
    """(key, item_key, shared, shingles, containment) of each item that a document contains.

    Containment is the share of the item's distinct ``width``-word shingles that occur in the whole
    document. Candidates come from the MinHash index, then all shingles of the item are looked up.
    Word numbers stand for words, so a shingle code is exact up to a collision of 64 bits.

    Documents are not shuffled. The index of ``block`` items and about ``BLOCK_BYTES`` of their texts is sent
    out once; a larger benchmark is cut into blocks by a hash, one pass over the documents for each.

    Null and empty texts contain nothing and are found nowhere. Items of fewer than ``width`` words are
    not looked for, unless with ``short``: then all words of such an item are its one shingle, and items
    that are still not looked for (under ``LEAST`` words, which stand in clean documents too) give a row
    each with null key and null containment. A null item key is kept. Item keys may be of any type that
    casts to text and back (numbers, decimals, text, dates), document keys of any type.
    Repeated documents and items each give their rows. Other columns are not read.
    """
    sides = items.select(F.col(item_key), F.col(text))
    narrow = docs.select(F.col(key), F.col(text))
    kind, item_kind = narrow.schema[0].dataType.simpleString(), sides.schema[0].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {{}}, shared int, shingles int, containment double"
    found = None
    for index in _indexes(sides, block, threshold, width, short):

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, at, hits = index.names, [], []
                for place, body in enumerate(batch.column(1)):
                    for hit in index.search(body.as_py()):
                        at.append(place)
                        hits.append(hit)
                shared = [h[1] for h in hits]
                sizes = [h[2] for h in hits]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at, pa.int64())),
                        pa.array([names[h[0]] for h in hits], pa.string()),
                        pa.array(shared, pa.int32()),
                        pa.array(sizes, pa.int32()),
                        pa.array([a / b for a, b in zip(shared, sizes, strict=True)], pa.float64()),
                    ],
                    [key, item_key, "shared", "shingles", "containment"],
                )

        part = narrow.mapInArrow(search, schema.format("string"))
        part = part.withColumn(item_key, F.col(f"`{item_key}`").cast(item_kind))
        found = part if found is None else found.unionByName(part)
    return found.unionByName(_unmatched(sides, width, schema.format(item_kind))) if short else found


def _indexes(sides: DataFrame, block: int, threshold: float, width: int, short: bool) -> Iterator[Index]:
    """The index of each block of (item key, text) rows; keys as text."""
    key, text = (F.col(f"`{c}`") for c in sides.columns)
    rows, size = sides.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    blocks = max(1, ceil(rows / block), ceil(size / BLOCK_BYTES))
    placed = sides.select(key.cast("string"), text, F.pmod(F.xxhash64(key, text), F.lit(blocks)).alias("_block"))
    for number in range(blocks):
        found = placed.filter(F.col("_block") == number).collect()
        yield Index([(r[0], r[1]) for r in found], threshold, width, short)


def _unmatched(items: DataFrame, width: int, schema: str) -> DataFrame:
    """The (item key, text) rows that ``short`` does not look for, as rows of that schema."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left = [not searched(words(text.as_py()), width, True) for text in batch.column(1)]
            names = batch.column(0).filter(pa.array(left, pa.bool_()))
            yield pa.RecordBatch.from_arrays([names], [item_key])

    item_key = items.columns[0]
    kind = items.schema[0].dataType.simpleString()
    names = items.mapInArrow(rows, f"`{item_key}` {kind}")
    zero, nothing = F.lit(0), F.lit(None)
    made = {"shared": zero, "shingles": zero, "containment": nothing, item_key: F.col(item_key)}
    fields = T._parse_datatype_string(schema).fields
    return names.select([made.get(f.name, nothing).cast(f.dataType).alias(f.name) for f in fields])


def without_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that contain no item, all their columns; see ``contained_items``.

    Decided inside the row, so it takes one pass for each block and no shuffle.
    """
    text = options.get("text", "text")
    threshold, width = options.get("threshold", 0.8), options.get("width", WIDTH)
    sides = items.select(F.col(options.get("item_key", "item_id")), F.col(text))
    for index in _indexes(sides, options.get("block", BLOCK), threshold, width, options.get("short", False)):
        docs = docs.filter(_clean(index)(F.col(text)))
    return docs


def _clean(index):
    @F.arrow_udf("boolean")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([not index.search(body.as_py()) for body in texts], pa.bool_())

    return clean


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text")
    return contained_items(docs, read(spark, sf, "benchmark", "item_id", "text"), short=True)


def _shingle_sql(table: str, key: str) -> str:
    """Distinct shingles of a table's texts, as text."""
    return rf"""SELECT DISTINCT {key}, unnest(list_transform(range(1, len(w) - {WIDTH - 2}),
    lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS s
  FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM {table})"""


SQL = f"""
WITH doc AS ({_shingle_sql('documents', 'doc_id')}),
item AS ({_shingle_sql('benchmark', 'item_id')}),
sized AS (SELECT item_id, count(*) AS n FROM item GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*) AS shared FROM doc JOIN item USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared::INTEGER AS shared, n::INTEGER AS shingles, shared::DOUBLE / n AS containment
FROM hits JOIN sized USING (item_id) WHERE shared >= 0.8 * n - 1e-9
"""
