"""Archives: what is written is read back, equal payloads once."""

import base64
import hashlib
import io
from collections import Counter

import pytest
import zstandard

from doclens.llm import warc

SCHEMA = "page_id long, url string, html string, row string, first int, digest string, payload int"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def wanted(rows, least):
    """(key, bytes, digest, type, refers) of (page_id, url, html) rows."""
    groups = {}
    for r in rows:
        groups.setdefault((r[2] or "").encode(), []).append(r[0])
    out = []
    for body, keys in groups.items():
        keys.sort(key=lambda k: (k is not None, k or 0), reverse=True)
        for place, key in enumerate(keys):
            later = place > 0 and len(body) >= least
            out.append((key, len(body), digest(body), "revisit" if later else "response", keys[0] if later else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, tmp_path, least):
    rows = [(i, f"https://h{i % 3}.org/é?q= {i}\r\nX: y", f"<p>page {i % 40} \r\n\r\n WARC/1.1 {'ü' * (i % 5)}</p>" * 5) for i in range(300)]
    rows += [(7, "u", None), (8, None, ""), (9, "", ""), (None, "n", "no key"), (None, "n", "no key"), (11, "x", "y" * 3_000_000)]
    rows += [(500, "same", "one row again")] * 20 + [(501, "hot", "<html>hot</html>")] + [(i, "hot", "<html>hot</html>") for i in range(400, 480)]
    frame = spark.createDataFrame([(*r, "a", 1, "b", 2) for r in rows], SCHEMA)
    folder = str(tmp_path / "warc")
    manifest = warc.write_archives(frame, f"file://{folder}", least=least, size=10_000).collect()
    assert sum(r.records for r in manifest) == len(rows) and len(manifest) > 8
    back = warc.read_archives(spark, f"file://{folder}").collect()
    found = Counter((r.key and int(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in back)
    assert found == wanted(rows, least)
    bodies = Counter(bytes(r.payload) for r in back if r.record_type == "response")
    assert set(bodies) == {(r[2] or "").encode() for r in rows}
    assert all(r.payload is None for r in back if r.record_type == "revisit")
    assert all("\n" not in r.url and " " not in r.url for r in back)


def test_archive_form(spark, tmp_path):
    """A skippable frame with the dictionary, then a frame per record that this dictionary decodes."""
    rows = [(i, f"u{i}", f"<html><body>the same words over and over, page {i}</body></html>" * 20) for i in range(400)]
    folder = str(tmp_path / "warc")
    (row,) = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).repartition(1), folder, size=1 << 30).limit(1).collect()
    data = open(f"{folder}/archives/{row.archive}", "rb").read()
    assert int.from_bytes(data[:4], "little") == warc.FRAME
    size = int.from_bytes(data[4:8], "little")
    known = data[8 : 8 + size]
    assert known.startswith(warc.DICTIONARY)
    rest, texts = data[8 + size :], []
    while rest:
        frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(known)).decompressobj()
        texts.append(frame.decompress(rest))
        rest = frame.unused_data
    assert len(texts) == row.records + 1 and warc.parse(texts[0])[0]["WARC-Type"] == "warcinfo"
    assert all(t.startswith(b"WARC/1.1\r\n") and t.endswith(b"\r\n\r\n") for t in texts)
    assert len(data) < row.raw_bytes / 5


def test_few_records_have_no_dictionary():
    data = warc.pack([b"one"])
    assert list(warc.unpack(io.BytesIO(data))) == [b"one"]
    assert int.from_bytes(data[:4], "little") != warc.FRAME
    assert list(warc.unpack(io.BytesIO(b""))) == []


def test_compressed_dictionary_and_cut_archive():
    records = [f"record {i} with the usual words of a record".encode() * 30 for i in range(500)]
    data = warc.pack(records)
    size = int.from_bytes(data[4:8], "little")
    small = zstandard.ZstdCompressor().compress(data[8 : 8 + size])
    other = data[:4] + len(small).to_bytes(4, "little") + small + data[8 + size :]
    assert list(warc.unpack(io.BytesIO(other))) == records
    with pytest.raises(ValueError):
        list(warc.unpack(io.BytesIO(data[:-3])))


def test_leftovers_are_not_read_and_damage_is_seen(spark, tmp_path):
    folder = str(tmp_path / "warc")
    rows = [(i, "u", f"text {i}") for i in range(50)]
    manifest = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder).collect()
    name = f"{folder}/archives/{manifest[0].archive}"
    data = open(name, "rb").read()
    open(f"{folder}/archives/left.warc.zst", "wb").write(data)
    assert warc.read_archives(spark, folder).count() == 50
    records = [r.replace(b"text ", b"tixt ") for r in warc.unpack(io.BytesIO(data))]
    open(name, "wb").write(warc.pack(records))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, folder).collect()


def test_nothing(spark, tmp_path):
    folder = str(tmp_path / "warc")
    assert warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder).count() == 0
    assert warc.read_archives(spark, folder).count() == 0


def test_text_keys(spark, tmp_path):
    rows = [("a:b/%20 é", "u", "x"), ("null", "u", "y"), (None, "u", "z"), ("key.", "u", "x")]
    folder = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"), folder)
    assert {(r.key, r.refers_to) for r in warc.read_archives(spark, folder).collect()} == {("a:b/%20 é", "key."), ("null", None), (None, None), ("key.", None)}
