"""WARC archives whose records are compressed one by one with a dictionary of their own archive.

An archive file is a skippable Zstandard frame that holds the dictionary, then one frame per record, so
any record can be read with the dictionary and its place alone. Tasks write the files; their names come
back as rows and are written to a manifest, so what a lost or repeated task left behind is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import read, ships
from doclens.operators.lookup import skew_safe_lookup, with_row_number
from doclens.session import scratch_path

ships(__name__)

# Fixed values of the formats: the skippable frame for a dictionary, a dictionary's first bytes, the
# profile of a record whose payload was seen before.
FRAME, DICTIONARY = 0x184D2A5D, b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONFORMS = "http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/"
# Bytes of records to an archive, of its dictionary, and of the records the dictionary is built from.
ARCHIVE, WORDS, SAMPLE = 32 << 20, 64 << 10, 2 << 20
# Bytes read at a time.
CHUNK = 1 << 18
_SAFE = "%!#$&'()*+,/:;=?@[]~-._|^`{}\"\\"


# --- records ---


def record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in headers.items()]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}", "", ""])
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def _name(key: str | None, row: int) -> str:
    """A record's id: its key, escaped, and a number that is unique to the row."""
    return f"<urn:doclens:{'null' if key is None else 'key.' + quote(key, safe='')}:{row}>"


def _key(name: str) -> str | None:
    held = name.split(":")[2]
    return None if held == "null" else unquote(held.removeprefix("key."))


def page_record(key: str | None, row: int, url: str | None, payload: bytes, digest: str, first: tuple | None, date: str) -> bytes:
    """A response, or a revisit of ``first`` (key, row): HTTP headers with the payload's length, no payload."""
    name = _name(key, row)
    headers = {
        "WARC-Type": "response" if first is None else "revisit",
        "WARC-Record-ID": name,
        "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe=_SAFE) if url else name.strip("<>"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
    }
    if first is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _name(*first)}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    return record(headers, http.encode() + (payload if first is None else b""))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- archives ---


def dictionary(records: list[bytes], words: int = WORDS, sample: int = SAMPLE) -> bytes:
    """A Zstandard dictionary from records evenly spread over an archive, ``sample`` bytes of them at most,
    those of few records cut into pieces. Empty where there is too little to build one: the archive then
    has no dictionary frame."""
    step = max(1, -(-sum(map(len, records)) // sample))
    chosen = [r[:sample] for r in records[::step]]
    if len(chosen) < 16:
        data = b"".join(chosen)
        size = max(64, len(data) // 16)
        chosen = [data[i : i + size] for i in range(0, len(data), size)]
    try:
        return zstandard.train_dictionary(words, chosen).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack(records: list[bytes], words: int = WORDS, sample: int = SAMPLE, level: int = 3) -> bytes:
    """The bytes of an archive."""
    made = dictionary(records, words, sample)
    known = zstandard.ZstdCompressionDict(made) if made else None
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=known)
    parts = [FRAME.to_bytes(4, "little"), len(made).to_bytes(4, "little"), made] if made else []
    return b"".join([*parts, *map(squeeze.compress, records)])


def unpack(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time, from a file that is open for reading."""
    data = stream.read(8)
    known = None
    if data[:4] == FRAME.to_bytes(4, "little"):
        known = stream.read(int.from_bytes(data[4:], "little"))
        data = b""
        if not known.startswith(DICTIONARY):  # the dictionary itself may be compressed
            known = zstandard.ZstdDecompressor().decompress(known)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known) if known else None)
    frame, parts = reader.decompressobj(), []
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            break
        parts.append(frame.decompress(data))
        data = b""
        if frame.eof:
            yield b"".join(parts)
            data = frame.unused_data
            frame, parts = reader.decompressobj(), []
    if parts:
        raise ValueError("archive ends inside a record")


# --- Spark ---


def with_first(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """(row, key, url, digest, packed, first): of rows with equal payloads of ``least`` bytes or more,
    ``first`` is (key, row) of the one with the largest key, null in that row and where there is no other.

    Rows are numbered and written, with their digests and compressed payloads, so equal keys and repeated
    rows stay apart: of those one is the first. Digests are looked up without their payloads; the
    commonest are broadcast."""

    @F.arrow_udf("struct<digest: string, size: bigint, packed: binary>")
    def read_once(payloads: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=1)
        bodies = [p.as_py() for p in payloads]
        parts = [pa.array(map(payload_digest, bodies), pa.string()), pa.array(map(len, bodies), pa.int64())]
        return pa.StructArray.from_arrays([*parts, pa.array(map(squeeze.compress, bodies), pa.binary())], ["digest", "size", "packed"])

    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), read_once(body).alias("_read"))
    rows = with_row_number(rows.select("key", "url", "_read.*"), "row")
    facts = rows.filter(F.col("size") >= least).select("row", "key", "digest")
    largest = facts.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("key", "row")).alias("first"))
    found = skew_safe_lookup(facts.select("row", "digest"), largest.filter("n > 1").select("digest", "first"), "digest")
    later = found.filter(F.col("first.row") != F.col("row")).select("row", "first")
    return rows.drop("size").join(later, "row", "left")


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0,
    date: str = "1970-01-01T00:00:00Z", size: int = ARCHIVE, words: int = WORDS, sample: int = SAMPLE,
) -> DataFrame:
    """Write a record per page to ``folder``/archives and give the manifest (archive, records, bytes,
    raw_bytes), which is written to ``folder``/manifest.

    ``folder`` is a path or address that executors can write to (local and mounted, HDFS, S3 and what
    else pyarrow opens). An archive has records of some ``size`` bytes; a task holds one at a time. Its
    dictionary is built from at most ``sample`` bytes of its own records, so no model is shared or sent.
    Of equal payloads of at least ``least`` bytes one is stored, see ``with_first``. Null payload: empty;
    null or empty url: the record's id stands for it; control and other characters that a header cannot
    hold are percent-encoded. No pages make no archive. Other columns are not read.
    """
    spark = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{path}/archives", recursive=True)
        held: list[bytes] = []
        raw = 0

        def made() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            info = f"software: doclens\r\nformat: WARC File Format 1.1\r\nconformsTo: {CONFORMS}\r\n"
            headers = {
                "WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:doclens:archive:{name}>", "WARC-Date": date,
                "WARC-Filename": name, "Content-Type": "application/warc-fields",
            }
            data = pack([record(headers, info.encode()), *held], words, sample)
            with store.open_output_stream(f"{path}/archives/{name}", compression=None) as out:
                out.write(data)
            values = [[name], [len(held)], [len(data)], [raw]]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in values], ["archive", "records", "bytes", "raw_bytes"])

        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for row, name, address, digest, packed, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                before = None if first is None else (first["key"], first["row"])
                held.append(page_record(name, row, address, expand.decompress(packed), digest, before, date))
                raw += len(held[-1])
                if raw >= size:
                    yield made()
                    held, raw = [], 0
        if held:
            yield made()

    rows = with_first(pages, key, url, payload, least)
    first = F.when(F.col("first").isNotNull(), F.struct(F.col("first.key").cast("string").alias("key"), F.col("first.row").alias("row")))
    rows = rows.select("row", F.col("key").cast("string").alias("key"), "url", "digest", "packed", first.alias("first"))
    made = rows.mapInArrow(run, "archive string, records bigint, bytes bigint, raw_bytes bigint")
    made.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """(archive, record_type, key, url, payload_bytes, payload_digest, refers_to, payload) of each page
    record in the archives that ``folder``/manifest names.

    A response's length and digest are taken from the payload read, and must be those of its headers; a
    revisit has no payload, its length and digest are those its headers state. Keys are text. Records
    pass by one at a time; an archive is read by one task. ``payloads`` off leaves the payload null.
    """
    names = ["archive", "record_type", "key", "url", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{path}/archives/{archive}", compression=None) as stream:
                    for data in unpack(stream):
                        headers, block = parse(data)
                        kind = headers["WARC-Type"]
                        if kind not in ("response", "revisit"):
                            continue
                        http, body = block.split(b"\r\n\r\n", 1)
                        stated = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
                        length, digest = int(stated["Content-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(body), payload_digest(body)) != (length, digest):
                            raise ValueError(f"record {headers['WARC-Record-ID']} of {archive} is damaged")
                        refers = headers.get("WARC-Refers-To")
                        rows.append((
                            archive, kind, _key(headers["WARC-Record-ID"].strip("<>")), headers["WARC-Target-URI"], length,
                            digest, refers and _key(refers.strip("<>")), body if payloads and kind == "response" else None,
                        ))
                        held += len(body)
                        if held >= CHUNK * 16 or len(rows) >= 4096:
                            yield made(rows)
                            rows, held = [], 0
                if rows:
                    yield made(rows)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = spark.read.parquet(f"{folder}/manifest").select("archive").repartition(tasks, "archive")
    schema = "archive string, record_type string, key string, url string, payload_bytes bigint, payload_digest string"
    return listed.mapInArrow(run, f"{schema}, refers_to string, payload binary")


def query(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages", "page_id", "url", "html")
    folder = scratch_path(spark, "warc")
    write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    return read_archives(spark, folder, payloads=False).select(
        F.col("key").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_FIVE = "('0x' || substr(hex, 5 * i + 1, 5))::BIGINT"
_BASE32 = " || ".join(f"substr('{_LETTERS}', ((({_FIVE}) >> {shift}) & 31)::INTEGER + 1, 1)" for shift in (15, 10, 5, 0))
SQL = f"""
WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
ranked AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS largest FROM hashed
  WINDOW w AS (PARTITION BY body ORDER BY page_id DESC NULLS LAST))
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(8), lambda i: {_BASE32}), 'string_agg', '') AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place > 1 THEN largest END AS refers_to FROM ranked
"""
