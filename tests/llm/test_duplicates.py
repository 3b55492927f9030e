"""SimHash index, paragraph sketches and suffix sorting against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from doclens.llm import fingerprint, simhash, suffixes
from doclens.llm.components import components


def _roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    found = {r.u: r.v for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    roots = _roots(400, pairs)
    assert all(found.get(x, x) == roots[x] for x in range(400))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_every_five_positions_hold_a_set():
    from itertools import combinations

    for count in (10, 1 << 30, 1 << 40):
        rule = simhash.bits_index(count)
        for five in combinations(range(8), 5):
            assert any(set(s) <= set(five) for s in rule.sets())


@pytest.mark.parametrize("part", [3, 2048])
def test_links_brute_force(spark, part):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 62, 6)
    fps = set()
    for c in centres.tolist():
        for _ in range(60):
            fps.add(c ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False)))
    fps = sorted(fps)
    pairs = [(i, j) for j in range(len(fps)) for i in range(j) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    nodes = spark.createDataFrame([(f, f.to_bytes(8, "big")) for f in fps], "node long, index binary")
    nodes = nodes.withColumn("verify", F.col("index"))
    links = simhash.near_links(nodes, simhash.bits_index(len(fps)), part)
    at = {f: i for i, f in enumerate(fps)}
    assert _roots(len(fps), pairs) == _roots(len(fps), [(at[r.u], at[r.v]) for r in links.collect()])


def _simhash(text):
    w = text.encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash_of_odd_texts(spark):
    texts = ["", "one", "one two", "A B\tc\nd\x0b\x0cE f", "É é \x1c x y", "a b c " * 3000, "same  words here", "SAME words here"]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(100, None, None), (None, "one", None), (1, "one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id is not None and r.doc_id < 100:
            assert r.fp & (2**64 - 1) == _simhash(texts[r.doc_id])
    ids = {r.doc_id: r.component_id for r in found}
    assert ids[100] == 0 and ids[None] == 1 and ids[7] == 6 and ids[5] == 5
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    # the engine's own hash is the same function
    value = spark.sql("SELECT xxhash64('one two')").first()[0]
    assert value & (2**64 - 1) == _simhash("one two")


def test_one_of_each(spark):
    """Groups by three bits of difference, from texts with words changed, blocks added and exact copies."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choices(words, k=rng.choice([3, 40, 300, 900])) for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i, b in enumerate(base):
        near = list(b)
        near[rng.randrange(len(b))] = "changed"
        rows += [(100 + i, " ".join(near)), (200 + i, " ".join(b + ["added"])), (300 + i, " ".join(b)), (300 + i, " ".join(b))]
    rows += [(900, None), (901, ""), (902, "lone"), (903, "LONE\n")]
    keys = sorted({key for key, _ in rows})
    fps = {key: _simhash(text or "") for key, text in rows}
    pairs = [(i, j) for j in range(len(keys)) for i in range(j) if bin(fps[keys[i]] ^ fps[keys[j]]).count("1") <= 3]
    roots = _roots(len(keys), pairs)
    wanted = [keys[i] for i in range(len(keys)) if roots[i] == i]
    assert len(wanted) < len(keys) - 45 and {100, 200, 901, 903}.isdisjoint(wanted)
    rows += [(None, rows[0][1]), (None, "no key")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, node string, component_id int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == wanted
    assert kept.filter("doc_id is null").count() == 2
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_large_groups_of_near_copies(spark):
    """More near fingerprints than a short index entry holds, every one within reach of some other."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(50_000)}" for _ in range(500)]
    rows = [(0, " ".join(base))]
    for i in range(1, 400):
        at = rng.randrange(490)
        rows.append((i, " ".join(base[:at] + [f"x{i}"] + base[at:])))
    fps = [_simhash(text) for _, text in rows]
    pairs = [(i, j) for j in range(len(fps)) for i in range(j) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    wanted = sorted({r for r in _roots(len(fps), pairs)})
    assert len(set(fps)) > 20 and len(wanted) < 100
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == wanted


def _signed(text):
    h = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def _paragraphs(text):
    """Digests of the paragraphs of a text by the rule of ``fingerprint.paragraphs``."""

    def mark(word):
        if len(word) > 64:
            return re.sub("[^ \\t\\n\\x0b\\f\\r。！？]{1,64}[。！？]*", "\\g<0>\\n", word)
        return word + "\n" if _signed(word) % 16 == 0 else word

    marked = " ".join(map(mark, text.split(" ")))
    return {_signed(p.strip(" ")) for p in marked.split("\n") if p.strip(" ")}


def test_versions_brute_force(spark):
    rng = random.Random(3)
    lines = [f"line {i} é𝄞" for i in range(40)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.choice([0, 1, 3, 12, 60])))) for i in range(30)]
    rows += [(50, "x"), (51, "ab"), (52, "\n\n"), (60, "\n".join(f"l{i}" for i in range(900)))]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, edited string")
    found = {r.doc_id: r for r in fingerprint.compare_versions(fingerprint.edited_versions(docs)).collect()}
    order = sorted(rows, reverse=True)

    def like(a, b):
        a, b = _paragraphs(a), _paragraphs(b)
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

    for place, (key, text) in enumerate(order):
        after = order[(place + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        r = found[key]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - like(text, edited)) < 1e-12
        assert abs(r.near_next - like(text, after)) < 1e-12
        old, new = _paragraphs(text), _paragraphs(edited)
        assert (r.gone, r.new) == (sorted(old - new), sorted(new - old))


def test_one_line_with_an_edited_tail(spark):
    """A line of 300 words, a run without spaces and a text in a script without spaces: cut below the line."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(9_000)}" for _ in range(300)]
    run = "".join(rng.choices("abcdef0123456789", k=6_000))
    unspaced = "".join("。" if rng.random() < 0.1 else rng.choice("的一是不了人我在有他") for _ in range(900))
    rows = [(1, " ".join(words), " ".join(words[:290] + ["a", "b"])), (2, " ".join(words), " ".join(["in", "front", *words]))]
    rows += [(3, run, run[:4_000] + "x" * 2_000), (4, unspaced, unspaced[:600] + "人" * 300)]
    rows += [(5, " ".join(words), " ".join(words[:200]) + " " + " ".join(f"v{i}" for i in range(100)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string, edited string")
    found = fingerprint.compare_versions(frame.withColumn("next_digests", F.array().cast("array<bigint>"))).collect()
    assert len(found) == 5
    assert all(0.5 < r.near_edited < 1 and r.near_next == 0 for r in found)
    assert all(r.near_edited > 0.8 for r in found if r.doc_id < 3)


def test_stored_fingerprints_give_the_digests(spark):
    """Two fingerprints, read back from text and without the texts, give what differs or say they cannot."""
    rng = random.Random(9)
    lines = [f"line number {i}" for i in range(500)]
    pairs = [("\n".join(lines), "\n".join(lines[:250] + ["put in"] + lines[251:])), ("", ""), ("a\nb", "a\nb")]
    pairs += [("\n".join(lines[:97]), "\n".join(lines[:95])), ("\n".join(lines[:400]), "\n".join(lines[:380]))]
    pairs += [("\n".join(lines[:200]), "\n".join(f"other {rng.random()}" for _ in range(200)))]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, a string, b string")

    def form(name):
        return fingerprint.text_form(fingerprint.fingerprint(fingerprint.paragraphs(F.col(name))))

    stored = frame.select("id", form("a").alias("a"), form("b").alias("b"))
    read = stored.select("id", *[fingerprint.from_text(F.col(c)).alias(c) for c in "ab"])
    found = {r.id: r.d for r in read.select("id", fingerprint.difference(F.col("a"), F.col("b")).alias("d")).collect()}
    for i, (a, b) in enumerate(pairs[:-1]):
        a, b = _paragraphs(a), _paragraphs(b)
        assert (set(found[i].gone), set(found[i].new)) == (a - b, b - a)
        assert len(found[i].gone) == len(a - b) and len(found[i].new) == len(b - a)
    assert found[len(pairs) - 1] is None
    sizes = stored.select(F.length(F.unbase64("a"))).collect()
    assert sizes[0][0] > sizes[2][0]


def test_versions_of_odd_rows(spark):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (1, "q" * 9), (2, None), (None, "abcdef"), (3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fingerprint.edited_versions(docs).collect()
    edited = sorted((r.doc_id or 0, r.text, r.edited) for r in found)
    assert edited == [
        (0, "abcdef", "abcd"), (1, "a\nb\nc", "a\nb\nz"), (1, "a\nb\nc", "a\nb\nz"), (1, "q" * 9, "q" * 6 + "z"),
        (2, "", ""), (3, "z", "z"),
    ]
    compared = fingerprint.compare_versions(fingerprint.edited_versions(docs)).collect()
    assert len(compared) == len(rows)
    assert len({r.fingerprint for r in compared if r.n_chars == 5}) == 1
    assert fingerprint.compare_versions(fingerprint.edited_versions(docs.limit(0))).count() == 0


def test_deep_shallow_order():
    rng = np.random.default_rng(4)
    rows = rng.integers(97, 99, (3000, 100)).astype(np.uint8)
    rows[500:1500, :60] = 97
    rows[1500:1800] = rows[700]
    rows[1800:2400, :95] = 98
    order = suffixes.deep_shallow(rows)
    assert sorted(order.tolist()) == list(range(3000))
    strings = [rows[i].tobytes() for i in order]
    assert strings == sorted(strings)
    shared = suffixes.common_prefixes(rows, order)
    for i in range(1, 3000, 97):
        a, b = strings[i - 1], strings[i]
        assert shared[i] == next((k for k in range(100) if a[k] != b[k]), 100)


def test_blind_trie():
    rng = random.Random(5)
    strings = list({bytes(rng.choice(b"ab\0") for _ in range(12)) for _ in range(300)})
    assert [strings[i] for i in suffixes.blind_trie(strings)] == sorted(strings)
    assert suffixes.blind_trie([b"x"]) == [0]


def _remove(rows, length=100):
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        mask = bytearray(len(data))
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                mask[i : i + length] = b"\1" * length
            seen.add(part)
        kept = bytes(b for b, m in zip(data, mask, strict=True) if not m)
        runs = sum(m and (i == 0 or not mask[i - 1]) for i, m in enumerate(mask))
        out.append((key, len(data), sum(mask), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_brute_force(spark):
    rng = random.Random(6)
    letters = "abcdefghé \n"
    passages = ["".join(rng.choices(letters, k=n)) for n in (90, 99, 100, 101, 150, 400)]
    rows = []
    for i in range(60):
        text = "".join(
            rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.choice([1, 5, 60])))
            for _ in range(rng.choice([0, 1, 4, 12]))
        )
        rows.append((i, text))
    rows += [(70, "a" * 700), (71, "ab" * 150), (72, "\0" * 250), (73, None), (74, rows[3][1]), (75, "\0" * 120)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, spans string").repartition(5)
    found = suffixes.without_repeats(docs).drop("kept").collect()
    assert sorted(tuple(r) for r in found) == _remove(rows)


def test_repeats_of_odd_rows(spark):
    rng = random.Random(8)
    a, b = ("".join(rng.choices("abcdef", k=300)) for _ in range(2))
    rows = [(1, a), (1, a), (2, a), (None, b), (3, b), (3, a + b)]
    found = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    removed = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in found)
    assert removed == [(0, 300, 0), (1, 300, 0), (1, 300, 0), (2, 300, 300), (3, 300, 300), (3, 600, 600)]
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeats_keep_the_type_of_the_key(spark):
    docs = spark.createDataFrame([(2, "ab" * 99), (1, "ab" * 99)], "doc_id int, text string")
    found = suffixes.without_repeats(docs)
    assert found.schema["doc_id"].dataType.simpleString() == "int"
    assert {r.doc_id: r.n_removed for r in found.collect()} == {1: 196, 2: 198}
    with pytest.raises(TypeError, match="whole number"):
        suffixes.without_repeats(docs.withColumn("doc_id", docs.doc_id.cast("string")))


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 500)
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcd") for _ in range(3000))

    def windows(texts):
        found = {}
        for data, ends, names, offsets in suffixes.pieces(texts, 100):
            code, place, first, last = suffixes.anchors(data, ends, 100)
            for c, p, f, z in zip(code.tolist(), place.tolist(), first.tolist(), last.tolist(), strict=True):
                k = int(np.searchsorted(ends, p, "right"))
                shift = offsets[k] - (int(ends[k - 1]) if k else 0)
                for s in range(f, z + 1):
                    found[names[k], s + shift] = c, p - s
        return found

    pieced = windows([text, text[:150], b"", text[1000:1400]])
    monkeypatch.setattr(suffixes, "PIECE", 1 << 21)
    assert pieced == windows([text, text[:150], b"", text[1000:1400]])
    assert len(pieced) == 2901 + 51 + 301


def test_repeats_over_texts_cut_into_slices(spark, monkeypatch):
    """Texts worked on a few at a time give the rows of texts worked on together."""
    rng = random.Random(21)
    passage = "".join(rng.choices("abcdé fgh", k=300))
    rows = [(i, "".join(rng.choices("xyz uvw", k=rng.randrange(0, 400))) + (passage if i % 3 else "") + "ab" * (i % 90)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, suffixes.without_repeats(docs).collect()))
    monkeypatch.setattr(suffixes, "TOGETHER", 700)
    assert sorted(map(tuple, suffixes.without_repeats(docs).collect())) == whole
