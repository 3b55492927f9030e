"""The pipeline's stages, each against brute force on its own input."""

from collections import Counter

import corpus_pipeline
import pytest
import xxhash
from doclens.llm import decontaminate

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows before and after each stage, over the smallest tables and some odd rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = docs.orderBy("doc_id").first()["text"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    odd = [
        (9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, "12 34 &&&", "en", "src1", 9),
        (9004, text + " more", "fr", None, 5), (9005, "Before. " + items[0]["text"] + " After.", "en", "src1", 400),
        (None, "A text without a key.", "en", "src2", 21), (9006, "the " * 40_000, "en", "src2", 160_000),
    ]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(3))
    out = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        after = stage(spark, rows, SF)
        if name != "sharding":
            assert after.columns == docs.columns
        after.write.parquet(path)
        before, rows = rows, spark.read.parquet(path)
        out.append((before.collect(), rows.collect()))
    return out


def test_language(steps):
    before, after = steps[0]
    wanted = [r for r in before if any(c.isalpha() for c in r["text"] or "")]
    assert Counter(after) == Counter(wanted)


def _fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_near_duplicates(steps):
    before, after = steps[1]
    fps = {r["doc_id"]: _fingerprint(r["text"]) for r in before if r["doc_id"] is not None}
    ids = sorted(fps)
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for k, b in enumerate(ids):
            for a in ids[:k]:
                if root[a] != root[b] and (fps[a] ^ fps[b]).bit_count() <= 3:
                    low, high = sorted((root[a], root[b]))
                    root = {i: low if r == high else r for i, r in root.items()}
                    changed = True
    wanted = {i for i, r in root.items() if i == r}
    assert wanted < set(ids)
    assert sorted(r["doc_id"] for r in after if r["doc_id"] is not None) == sorted(wanted)
    assert set(after) <= set(before)
    assert [r for r in after if r["doc_id"] is None] == [r for r in before if r["doc_id"] is None]


def test_decontamination(spark, steps):
    before, after = steps[2]
    items = [set(zip(*[decontaminate.words(r["text"])[i:] for i in range(5)])) for r in
             spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def clean(text):
        w = decontaminate.words(text)
        mine = set(zip(*[w[i:] for i in range(5)]))
        return not any(item and len(item & mine) >= 0.8 * len(item) for item in items)

    assert Counter(after) == Counter(r for r in before if clean(r["text"]))
    assert 9005 in {r["doc_id"] for r in before} - {r["doc_id"] for r in after}


def test_mixing(steps):
    before, after = steps[3]
    assert set(after) == set(before)
    drawn = Counter(after)
    tokens = Counter()
    for r in before:
        tokens[r["source"]] += len((r["text"] or "").split())
    for source in tokens:
        counts = {n for r, n in drawn.items() if r["source"] == source}
        assert max(counts) - min(counts) <= 1 and max(counts) <= 4


def test_sharding(steps):
    before, after = steps[4]
    assert Counter(r["doc_id"] for r in after) == Counter(r["doc_id"] for r in before)
    sizes = Counter(r["shard"] for r in after)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
