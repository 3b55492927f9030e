"""SimHash near-duplicates through an inverted index of positional bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from doclens.llm.common import read, ships
from doclens.llm.components import components
from doclens.session import written

ships(__name__)

# Fingerprints of one index entry that meet in one task; longer entries are cut into such parts.
PART = 2048


@dataclass(frozen=True)
class Index:
    """A positional-byte index: ``groups`` of positions, each keyed by all its sets of ``width`` bytes.

    Pairs that share fewer than ``shared`` positional bytes are dropped; of the rest those are linked
    whose fingerprints differ in at most ``differing`` bits.
    """

    groups: tuple[tuple[int, ...], ...]
    width: int
    shared: int
    differing: int

    def sets(self) -> list[tuple[int, ...]]:
        return [s for group in self.groups for s in combinations(group, self.width)]


def _bits(hashes: np.ndarray) -> np.ndarray:
    """Majority of each bit over rows of hash bytes, as packed bytes."""
    ones = np.zeros(8 * hashes.shape[1], np.int64)
    for start in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[start : start + (1 << 15)], axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(hashes), bitorder="little")


def tokens(text: str | None) -> list[bytes]:
    """Runs between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash: a bit is set where it is set in over half the XXH64 values of the shingles,
    repeats included. Fewer words make one shingle, no words fingerprint zero."""
    words = tokens(text)
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = zip(*(words[i:] for i in range(width))) if len(words) >= width else [words]
    hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, shingles), repeat(42)), np.uint64, n)
    return int(_bits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)).view("<u8")[0])


def _near(index: np.ndarray, verify: np.ndarray, i, j, rule: Index) -> np.ndarray:
    """Tally the positional bytes two fingerprints share; verify those with enough of them."""
    shared = (index[i] == index[j]).sum(axis=-1)
    bits = np.bitwise_count(verify[i] ^ verify[j]).sum(axis=-1)
    return (shared >= rule.shared) & (bits <= rule.differing)


def links_in_entry(index: np.ndarray, verify: np.ndarray, rule: Index) -> tuple[np.ndarray, np.ndarray]:
    """A star per connected group of one long index entry: as many links as fingerprints, not pairs."""
    n = len(index)
    near = np.zeros((n, n), bool)
    every = np.arange(n)[None, :]
    for start in range(0, n, 64):
        rows = np.arange(start, min(n, start + 64))[:, None]
        near[start : start + 64] = _near(index, verify, rows, every, rule)
    label = np.arange(n)
    while True:
        lowest = label.copy()
        for start in range(0, n, 256):
            rows = np.where(near[start : start + 256], label[None, :], n)
            lowest[start : start + 256] = np.minimum(label[start : start + 256], rows.min(axis=1))
        lowest = lowest[lowest]
        if (lowest == label).all():
            break
        label = lowest
    at = np.flatnonzero(label != np.arange(n))
    return at, label[at]


def links(
    entries: np.ndarray, index: np.ndarray, verify: np.ndarray, rule: Index, short: int = 16
) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links among rows with equal entry number; rows sorted by entry. Entries of more
    than ``short`` rows give stars."""
    n = len(entries)
    starts = np.flatnonzero(np.r_[True, entries[1:] != entries[:-1]]) if n else np.zeros(0, int)
    sizes = np.diff(np.r_[starts, n])
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    here = np.flatnonzero(np.repeat(sizes <= short, sizes))
    for step in range(1, short):
        here = here[here + step < n]
        here = here[entries[here] == entries[here + step]]
        good = here[_near(index, verify, here, here + step, rule)]
        left.append(good)
        right.append(good + step)
    for start, size in zip(starts[sizes > short], sizes[sizes > short]):
        whole = slice(start, start + size)
        a, b = links_in_entry(index[whole], verify[whole], rule)
        left.append(a + start)
        right.append(b + start)
    return np.concatenate(left), np.concatenate(right)


def _bytes(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as rows of bytes."""
    data = column.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    flat = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return flat.reshape(len(data), -1)


def _linker(rule: Index):
    """Links of the entries of one partition, rows (entry, node, index, verify) sorted by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def made(rows: list[np.ndarray]) -> pa.RecordBatch:
            i, j = links(rows[0], *rows[2:], rule)
            return pa.RecordBatch.from_arrays([pa.array(rows[1][i]), pa.array(rows[1][j])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]] + [_bytes(c) for c in batch.columns[2:]]
            if held is not None:
                rows = [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
            whole = int(np.searchsorted(rows[0], rows[0][-1]))  # an entry may go on in the next batch
            if whole:
                yield made([r[:whole] for r in rows])
            held = [r[whole:] for r in rows]
        if held is not None:
            yield made(held)

    return run


def near_links(distinct: DataFrame, rule: Index, part: int = PART) -> DataFrame:
    """Links (u, v) that join all nodes whose fingerprints share an index entry and pass the rule.

    ``distinct`` has ``node`` (bigint) and the binary ``index`` and ``verify`` fingerprints. An entry
    of the inverted index is one set of positions and its byte values. In an entry the shared bytes
    of each pair are tallied, pairs below the minimum are dropped, the rest verified. Entries of more
    than ``part`` fingerprints are cut into parts by hash, and each pair of parts is work of its own,
    so no task holds more than about two parts at a time; they give stars, not pairs.
    """
    marks = ["index", "verify"]
    sets = [
        F.struct(F.lit(i).alias("set"), F.concat(*[F.substring("index", p + 1, 1) for p in s]).alias("value"))
        for i, s in enumerate(rule.sets())
    ]
    postings = distinct.select("node", *marks, F.inline(F.array(*sets)))
    sizes = distinct.select(F.inline(F.array(*sets))).groupBy("set", "value").agg(F.count(F.lit(1)).alias("_n"))
    long = sizes.filter(F.col("_n") > part).withColumn("_parts", F.ceil(F.col("_n") / part).cast("int"))
    dealt = postings.join(long.drop("_n"), ["set", "value"], "left")
    parts = F.coalesce("_parts", F.lit(1))
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    cells = dealt.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), parts - 1)))
    entry = F.xxhash64("set", "value", F.least("_own", "_other"), F.greatest("_own", "_other"))
    rows = cells.select(entry.alias("entry"), "node", *marks)
    sorted_rows = rows.repartition("entry").sortWithinPartitions("entry")
    return sorted_rows.mapInArrow(_linker(rule), "u bigint, v bigint").distinct()


def bits_index(count: int) -> Index:
    """For 64-bit fingerprints that differ in three bits at most: these spoil three bytes at most, so
    linked ones share five of eight positional bytes, and any five positions hold a set of the index.

    Triples within either half do (of five positions three lie in one half). More fingerprints take
    longer keys, which keeps entries of random fingerprints near one row; every width finds all links.
    """
    if count <= 1 << 24:
        return Index((tuple(range(4)), tuple(range(4, 8))), 3, 5, 3)
    return Index((tuple(range(7)),), 4, 5, 3) if count <= 1 << 32 else Index((tuple(range(8)),), 5, 5, 3)


def near_duplicates(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) of every row: 64-bit fingerprints at most three bits apart are linked,
    and ``component_id`` is the smallest key that links reach, the row's own included.

    Copies share a fingerprint, so only distinct fingerprints are indexed. Null texts, and texts
    without a word, have fingerprint zero and are linked like others. Repeated rows give their rows.
    A null key gets the smallest key that is not null, null if there is none. Empty in, empty out.
    """

    @F.arrow_udf("bigint")
    def simhash(texts: pa.Array) -> pa.Array:
        values = np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64)
        return pa.array(values.view(np.int64), pa.int64())

    found = written(docs.select(F.col(key), simhash(F.col(text)).alias("fp")), "fingerprints")
    distinct = written(found.groupBy("fp").agg(F.min(key).alias("_first")), "distinct")
    as_bytes = F.unhex(F.lpad(F.hex("fp"), 16, "0"))
    nodes = distinct.select(F.col("fp").alias("node"), as_bytes.alias("index"), as_bytes.alias("verify"))
    stars = components(near_links(nodes, bits_index(distinct.count())))
    rooted = distinct.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("_root")), "fp", "left")
    rooted = rooted.withColumn("_root", F.coalesce("_root", "fp"))
    lowest = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    roots = rooted.select("fp", "_root").join(lowest, "_root").drop("_root")
    return found.join(roots, "fp").select(key, "fp", "component_id")


def one_of_each(docs: DataFrame, width: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of the smallest key of each group of ``near_duplicates``, all columns; of rows with equal
    keys, which are taken for one document, one.

    Rows with a null key are kept: nothing tells which of them stands for its group. Null texts and
    texts without a word are one group. Empty in, empty out."""
    keyed = docs.filter(F.col(key).isNotNull())
    groups = near_duplicates(keyed, width, key, text)
    first = groups.filter(F.col(key) == F.col("component_id")).select(key).distinct()
    kept = keyed.join(first, key, "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.filter(F.col(key).isNull()))


def query(spark: SparkSession, sf: str) -> DataFrame:
    docs = near_duplicates(read(spark, sf, "documents", "doc_id", "text"))
    return docs.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
