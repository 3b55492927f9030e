"""Repeated passages by suffix arrays, sorted deep-shallow.

Sorting every suffix of a corpus is out of reach, so suffixes are sampled by content: of each window of
``LENGTH`` bytes the ``GRAM`` bytes with the smallest hash are its anchor. Equal windows have equal
anchors at equal offsets, so two equal windows meet where suffixes of equal anchors are sorted, and
nothing is missed. The sort runs in four steps: find anchors whose hash occurs twice, cut the windows
around those out of the texts, sort them per hash bucket, and take the repeated bytes away.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doclens.llm.common import read, ships

ships(__name__)

GRAM = 20
# Bytes hashed at a time; longer texts go in overlapping pieces. Places in a piece fit 24 bits.
PIECE = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
# Bytes of text a task works on together: rows of a batch beyond that wait.
TOGETHER = 12 << 20
# Bytes compared by multikey quicksort before a group goes to a blind trie; groups of so few rows are
# ordered by insertion.
SHALLOW, FEW = 32, 24


# --- sorting ---


def blind_trie(strings: list[bytes]) -> list[int]:
    """Order of distinct strings of one length: a trie of the places where they branch only (Ferragina
    and Grossi's blind trie). A string is led to some leaf without looking at skipped bytes; one
    comparison with that leaf tells where it branches off."""
    size = len(strings[0])
    root: list | int = 0
    numbers = [int.from_bytes(s) for s in strings]
    for new in range(1, len(strings)):
        node = root
        while isinstance(node, list):
            branch = node[1].get(strings[new][node[0]])
            node = branch if branch is not None else next(iter(node[1].values()))
        common = size - ((numbers[new] ^ numbers[node]).bit_length() + 7) // 8
        parent, node = None, root
        while isinstance(node, list) and node[0] < common:
            parent, node = node, node[1][strings[new][node[0]]]
        if isinstance(node, list) and node[0] == common:
            node[1][strings[new][common]] = new
            continue
        leaf = node
        while isinstance(leaf, list):
            leaf = next(iter(leaf[1].values()))
        split = [common, {strings[leaf][common]: node, strings[new][common]: new}]
        if parent is None:
            root = split
        else:
            parent[1][strings[new][parent[0]]] = split
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, list):
            stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            order.append(node)
    return order


def deep_shallow(rows: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix: multikey quicksort, eight bytes to a key, to a shallow depth,
    then a blind trie for each group with a longer common prefix."""
    n, size = rows.shape
    padded = np.zeros((n, -(-size // 8) * 8), np.uint8)
    padded[:, :size] = rows
    words = padded.view(">u8").astype(np.uint64)
    data, step = padded.tobytes(), padded.shape[1]

    def string(i: int) -> bytes:
        return data[i * step : (i + 1) * step]

    order: list[np.ndarray] = []
    stack = [(np.arange(n), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) <= FEW:
            order.append(np.array(sorted(group.tolist(), key=string), np.int64))
        elif depth * 8 >= min(SHALLOW, step):
            equal: dict[bytes, list[int]] = {}
            for i in group.tolist():
                equal.setdefault(string(i), []).append(i)
            distinct = list(equal)
            order.extend(np.array(equal[distinct[k]], np.int64) for k in blind_trie(distinct))
        else:
            key = words[group, depth]
            pivot = np.sort(key[:: max(1, len(key) // 9)])[len(key[:: max(1, len(key) // 9)]) // 2]
            less, more = key < pivot, key > pivot
            for part, deeper in ((more, 0), (~(less | more), 1), (less, 0)):
                if part.any():
                    stack.append((group[part], depth + deeper))
    return np.concatenate(order) if order else np.zeros(0, np.int64)


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row, in order, with the one before it; -1 for the first."""
    sorted_rows = rows[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    return np.r_[-1, np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])] if len(rows) else np.zeros(0, int)


def repeated(right: np.ndarray, left: np.ndarray, least: np.ndarray, most: np.ndarray, length: int):
    """Windows around anchors that occur at an earlier anchor: (lowest, highest) offset, -1 for none.

    Rows stand in the order of the corpus. ``right`` holds the bytes from the anchor on, ``left`` those
    before it, backwards; row i has the windows that begin ``least[i]`` to ``most[i]`` bytes before its
    anchor. Two windows at offset o are equal when their suffixes share length - o bytes and their
    reversed prefixes o bytes; in sorted order both are runs, so each offset takes one pass.
    """
    n = len(right)
    low, high = np.full(n, -1), np.full(n, -1)
    runs = []
    for rows in (right, left):
        order = deep_shallow(rows)
        runs.append((order, common_prefixes(rows, order)))
    classes = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for offset in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        rows = np.flatnonzero((least <= offset) & (offset <= most))
        if len(rows) < 2:
            continue
        for (order, shared), wanted, into in zip(runs, (length - offset, offset), classes, strict=True):
            into[order] = np.cumsum(shared < wanted)
        key = classes[0][rows] * (n + 1) + classes[1][rows]
        by_key = np.argsort(key, kind="stable")
        again = rows[by_key[1:][key[by_key[1:]] == key[by_key[:-1]]]]
        low[again] = np.where(low[again] < 0, offset, low[again])
        high[again] = offset
    return low, high


# --- anchors ---


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows inside the texts of a piece: (hash, place, first window, last window)."""
    if len(data) < length:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    with np.errstate(over="ignore"):
        word = data.astype(np.uint64)
        for bits in (8, 16, 32):
            word = word[: -bits // 8] | (word[bits // 8 :] << np.uint64(bits))
        n = len(data) - GRAM + 1
        code = word[:n] * _MIX[0]
        code ^= code >> np.uint64(31)
        code += word[8 : 8 + n]
        code *= _MIX[1]
        code ^= code >> np.uint64(29)
        code += word[12 : 12 + n]
        code *= _MIX[0]
        code ^= code >> np.uint64(32)
    best = (code & ~_PLACE) | np.arange(n, dtype=np.uint64)
    span, have = length - GRAM + 1, 1
    while have < span:
        step = min(have, span - have)
        best = np.minimum(best[:-step], best[step:])
        have += step
    inside = np.ones(len(best), bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - length + 1) : end] = False
    windows = np.flatnonzero(inside)
    if not len(windows):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    best = best[windows]
    starts = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
    stops = np.r_[starts[1:], len(best)] - 1
    place = (best[starts] & _PLACE).astype(np.int64)
    return code[place], place, windows[starts], windows[stops]


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """Texts put together to pieces of ``PIECE`` bytes: (bytes, ends, text numbers, offset in the text)."""
    held: list[bytes] = []
    names: list[int] = []
    offsets: list[int] = []
    size = 0

    def made():
        return np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(h) for h in held]), names, offsets

    for number, text in enumerate(texts):
        for start in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[start : start + PIECE + length - 1]
            if len(part) < length:
                continue
            held.append(part)
            names.append(number)
            offsets.append(start)
            size += len(part)
            if size >= PIECE:
                yield made()
                held, names, offsets, size = [], [], [], 0
    if held:
        yield made()


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches with the texts of a column as bytes, cut so that some ``TOGETHER`` bytes are worked on at a
    time; an Arrow batch counts rows, whatever their length."""
    for batch in batches:
        bodies = batch.column(column).cast(pa.binary())
        batch = batch.set_column(column, batch.schema.names[column], bodies)
        ends = np.cumsum(pc.binary_length(bodies).to_numpy().astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def _pack(place: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    return (place << 16) | (most << 8) | least


def _squeeze(data: bytes) -> bytes:
    """Length and compressed bytes: places and windows repeat, and are shuffled."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True) if data else b""


def _expand(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True) if data else b""


def _binary(rows: list[dict], names: list[str], key: str) -> pa.RecordBatch:
    columns = [pa.array([r[key] for r in rows], pa.int32())]
    columns += [pa.array([_squeeze(r[name]) for r in rows], pa.binary()) for name in names]
    return pa.RecordBatch.from_arrays(columns, [key, *names])


def _scan(length: int, buckets: int):
    """Anchors of each batch of texts as one row per hash bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            ids, tags = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
            texts = batch.column(2).to_pylist()
            found: list[list[np.ndarray]] = [[], [], [], []]
            for data, ends, names, offsets in pieces(texts, length):
                code, place, first, last = anchors(data, ends, length)
                text = np.searchsorted(ends, place, "right")
                shift = np.array(offsets, np.int64)[text] - (np.r_[0, ends[:-1]])[text]
                owner = np.array(names, np.int64)[text]
                at = _pack(place + shift, place - first, place - last)
                for into, values in zip(found, (code, ids[owner], tags[owner], at), strict=True):
                    into.append(values)
            if not found[0]:
                continue
            code, owner, tag, at = map(np.concatenate, found)
            bucket = ((code >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            rows = [
                {
                    "bucket": int(bucket[part[0]]), "code": code[part].tobytes(), "id": owner[part].tobytes(),
                    "tag": tag[part].tobytes(), "at": at[part].tobytes(),
                }
                for part in np.split(order, cuts) if len(part)
            ]
            yield _binary(rows, ["code", "id", "tag", "at"], "bucket")

    return run


def _joined(batches: Iterator[pa.RecordBatch], kinds: list) -> list[np.ndarray]:
    """The byte columns of all rows of a partition, put together as arrays of the given kinds."""
    parts: list[list[np.ndarray]] = [[] for _ in kinds]
    for batch in batches:
        for k, kind in enumerate(kinds):
            parts[k].extend(np.frombuffer(_expand(v.as_py()), kind) for v in batch.column(k + 1))
    return [np.concatenate([np.zeros(0, kind), *p]) for p, kind in zip(parts, kinds, strict=True)]


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors whose hash occurs more than once."""
    code, owner, tag, at = _joined(batches, [np.uint64, np.int64, np.int64, np.int64])
    order = np.argsort(code)
    same = code[order[1:]] == code[order[:-1]]
    keep = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    columns = [pa.array(values[keep]) for values in (owner, tag, at)]
    yield pa.RecordBatch.from_arrays(columns, ["id", "tag", "at"])


def _cut(length: int, buckets: int):
    """The bytes of the windows around the chosen anchors, one row per bucket.

    Of anchors with equal windows among texts worked on together only the earliest goes on; the windows
    of the others are known to be repeated, and only their place is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 2):
            first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
            done: list[tuple[int, int, int, int]] = []
            for owner, tag, body, chosen in zip(*batch.columns, strict=True):
                owner, tag, data = owner.as_py(), tag.as_py(), body.as_py()
                for at in chosen.values.to_pylist():
                    place, most, least = at >> 16, (at >> 8) & 255, at & 255
                    key = most, data[place - most : place - least + length]
                    me = owner, tag, place
                    other = first.setdefault(key, me)
                    if other != me:
                        first[key] = min(me, other)
                        later = max(me, other)
                        done.append((*later[:2], later[2] - most, later[2] - least + length))
            groups: dict[int, list] = {}
            for (most, body), me in first.items():
                bucket = crc32(body[most : most + GRAM]) % buckets
                groups.setdefault(bucket, []).append((*me, most, len(body), body))
            rows = []
            for bucket, members in groups.items():
                numbers = [np.array([m[k] for m in members], np.int64).tobytes() for k in range(5)]
                rows.append(dict(zip(["id", "tag", "place", "most", "size"], numbers, strict=True)))
                rows[-1] |= {"bucket": bucket, "body": b"".join(m[5] for m in members), "done": b""}
            if done:
                empty = dict.fromkeys(["id", "tag", "place", "most", "size", "body"], b"")
                spread = crc32(str(done[0]).encode()) % buckets
                rows.append(empty | {"bucket": spread, "done": np.array(done, np.int64).tobytes()})
            yield _binary(rows, ["id", "tag", "place", "most", "size", "body", "done"], "bucket")

    return run


def _sort(length: int):
    """Spans of bytes that repeat earlier ones, from the windows of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [np.int64] * 5 + [np.uint8, np.int64]
        owner, tag, place, most, size, body, done = _joined(batches, kinds)
        begin = np.cumsum(size) - size
        order = np.lexsort((place, tag, owner))
        owner, tag, place, most, size, begin = (v[order] for v in (owner, tag, place, most, size, begin))
        least = most + length - size
        body = np.r_[body, np.zeros(1, np.uint8)]

        def take(start: np.ndarray, step: int, count: np.ndarray, width: int) -> np.ndarray:
            rows = np.zeros((len(start), width), np.uint8)
            for k in range(width):
                at = np.where(k < count, start + step * k, len(body) - 1)
                rows[:, k] = body[at]
            return rows

        anchor = begin + most
        right = take(anchor, 1, size - most, length)
        left = take(anchor - 1, -1, most, length - GRAM)
        low, high = repeated(right, left, least, most, length)
        hit = np.flatnonzero(low >= 0)
        done = done.reshape(-1, 4)
        starts = np.r_[place[hit] - high[hit], done[:, 2]]
        stops = np.r_[place[hit] - low[hit] + length, done[:, 3]]
        columns = [pa.array(np.r_[owner[hit], done[:, 0]]), pa.array(np.r_[tag[hit], done[:, 1]])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array((starts << 32) | stops)], ["id", "tag", "span"])

    return run


def _merge(spans: list[int] | None) -> list[tuple[int, int]]:
    """Overlapping and touching spans joined."""
    merged: list[tuple[int, int]] = []
    for span in sorted(spans or []):
        start, stop = span >> 32, span & 0xFFFFFFFF
        if merged and start <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(merged[-1][1], stop)
        else:
            merged.append((start, stop))
    return merged


# --- Spark ---


def repeated_spans(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id``, ``tag``, ``body``, ``spans``) of every row: the byte spans of its UTF-8 text that are
    covered by a string of ``length`` bytes which also starts earlier, in a smaller key or earlier in
    the same text. ``spans`` holds start * 2^32 + stop, unmerged; ``tag`` tells rows of one key apart.

    Texts are shuffled once, by key, and read from there twice; what else is shuffled is eight bytes
    and a place per anchor, about one in forty bytes, and the windows of the anchors that occur
    twice. A task sorts the windows of a hash bucket; buckets are many, and equal windows of ``TOGETHER`` bytes
    are merged before they are sent, so a passage on a third of all rows is one row for as many bytes.

    Null text is empty. A null key sorts first. Equal rows are one document and are judged alike; of
    rows with one key and different texts the one with the lower checksum is the earlier. Texts
    shorter than ``length`` bytes have no spans. Other columns are not read. Keys must be whole numbers,
    whose order says which document is earlier; others are a ``TypeError``.
    """
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise TypeError(f"{key} must be a whole number; number the documents first")
    spark = docs.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key_of = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))
    twins = docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    body = F.coalesce(F.col(text), F.lit(""))
    tag = F.lit(0).cast("bigint") if twins.isEmpty() else F.crc32(body)
    rows = docs.select(key_of.alias("id"), tag.alias("tag"), body.alias("body"))
    blob = "code binary, id binary, tag binary, at binary"
    found = rows.mapInArrow(_scan(length, buckets), f"bucket int, {blob}")
    twice = found.repartition("bucket").mapInArrow(_twice, "id bigint, tag bigint, at bigint")
    chosen = twice.distinct() if not twins.isEmpty() else twice
    chosen = chosen.groupBy("id", "tag").agg(F.collect_list("at").alias("at"))
    fields = ", ".join(f"{c} binary" for c in ("id", "tag", "place", "most", "size", "body", "done"))
    windows = rows.join(chosen, ["id", "tag"]).select("id", "tag", "body", "at")
    windows = windows.mapInArrow(_cut(length, buckets), f"bucket int, {fields}")
    spans = windows.repartition("bucket").mapInArrow(_sort(length), "id bigint, tag bigint, span bigint")
    spans = spans.groupBy("id", "tag").agg(F.collect_list("span").alias("spans"))
    return rows.join(spans, ["id", "tag"], "left")


def without_repeats(docs: DataFrame, length: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, kept_sha256) of every row; ``kept`` are the bytes left,
    ``n_spans`` the maximal runs of removed ones. See ``repeated_spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            out: list[list] = [[], [], [], [], []]
            for body, spans in zip(*batch.columns[1:], strict=True):
                data, kept, at, gone = body.as_py(), [], 0, _merge(spans.as_py())
                for start, stop in gone:
                    kept.append(data[at:start])
                    at = stop
                left = b"".join([*kept, data[at:]])
                values = len(data), len(data) - len(left), len(gone), left, hashlib.sha256(left).hexdigest()
                for into, value in zip(out, values, strict=True):
                    into.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            made = [pa.array(v, kind) for v, kind in zip(out, kinds, strict=True)]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names)

    found = repeated_spans(docs, length, key, text).select("id", "body", "spans")
    schema = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, kept_sha256 string"
    own = F.when(F.col("id") != -(1 << 63), F.col("id")).cast(docs.schema[key].dataType).alias(key)
    return found.mapInArrow(run, schema).select(own, "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256")


def query(spark: SparkSession, sf: str) -> DataFrame:
    return without_repeats(read(spark, sf, "documents", "doc_id", "text")).drop("kept")
