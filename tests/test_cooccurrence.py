"""Word vectors by co-occurrence: counts, factorisation and repeatability against plain computation."""

import random
from collections import Counter
from math import log

import numpy as np
import pytest

from doclens.operators import cooccurrence as K

SCHEMA = "doc_id long, tokens array<string>, n int"


def _rows():
    rng = random.Random(4)
    topics = [[f"{name}{i}" for i in range(12)] for name in "abc"]
    rows = [(i, rng.choices(topics[i % 3] + ["the"] * 6, k=rng.choice([1, 8, 30])), i) for i in range(150)]
    return rows + [(200, [], 0), (201, None, 0), (202, ["x", None, "x"], 0), (203, ["x", None, "x"], 0)]


def _counts(rows, window):
    found = Counter()
    for _, tokens, _ in rows:
        for i, a in enumerate(tokens or []):
            for j, b in enumerate(tokens):
                if 0 < abs(i - j) <= window and a is not None and b is not None:
                    found[a, b] += 1
    return found


def _information(counts):
    of, total = Counter(), sum(counts.values())
    for (a, _), n in counts.items():
        of[a] += n
    return {(a, b): max(0.0, log(n * total / (of[a] * of[b]))) for (a, b), n in counts.items()}


@pytest.fixture(scope="module")
def pairs(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    return K.information(K.written(K.cooccurrences(docs, 3), "pairs"))


def test_counts_and_information(pairs):
    counts = _counts(_rows(), 3)
    found = {(r.a, r.b): r for r in pairs.collect()}
    wanted = _information(counts)
    assert {k: r.n for k, r in found.items()} == counts
    assert all(abs(r.info - wanted[k]) < 1e-12 for k, r in found.items())


def test_factorisation_against_the_singular_vectors(spark, pairs):
    info = _information(_counts(_rows(), 3))
    names = sorted({a for a, _ in info})
    matrix = np.array([[info.get((a, b), 0.0) for b in names] for a in names])
    u, s, v = np.linalg.svd(matrix)
    for size, slack in ((len(names), 1e-4), (6, 0.02)):
        found = {r.symbol: r for r in K.factorise(pairs, size, rounds=6).collect()}
        vec, context = (np.array([found[n][c] for n in names if n in found]) for c in ("vec", "context"))
        held = [n in found for n in names]
        best = (u[:, :size] * s[:size]) @ v[:size]
        # the nearest table of this rank is not unique where singular values meet, its error is
        own = np.linalg.norm(vec @ context.T - matrix[np.ix_(held, held)])
        assert own <= np.linalg.norm(best - matrix) * (1 + slack) + 1e-3
        assert np.all(np.diff(np.linalg.norm(vec, axis=0)) < 1e-6)


def test_same_bits_however_the_rows_are_cut(spark):
    rows = _rows()
    found = []
    for parts, shuffle in ((1, "2"), (9, "13")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        random.Random(parts).shuffle(rows)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        vectors = K.fit_vectors(docs, 8, window=3, seed=3)
        means = K.mean_vectors(docs, vectors)
        found.append((sorted(map(tuple, vectors.collect())), sorted((r.doc_id, r.vec) for r in means.collect())))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_means_looked_up_and_joined(spark, monkeypatch):
    rows = _rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    vectors = K.fit_vectors(docs, 5, window=2)
    held = {r.symbol: np.array(r.vec) for r in vectors.collect()}
    looked = {r.doc_id: r for r in K.mean_vectors(docs, vectors).collect()}
    for key, tokens, n in rows:
        wanted = sum((held.get(t, np.zeros(5)) for t in tokens or []), np.zeros(5)) / max(1, len(tokens or []))
        assert np.allclose(looked[key].vec, wanted, atol=1e-8) and looked[key].n == n
    monkeypatch.setattr(K, "MAX_NUMBERS", 3)
    assert {r.doc_id: r for r in K.mean_vectors(docs, vectors).collect()} == looked


def test_limits_and_nothing(spark, pairs, monkeypatch):
    none = spark.createDataFrame([], SCHEMA)
    assert K.cooccurrences(none).count() == 0
    vectors = K.fit_vectors(none, 4)
    assert vectors.count() == 0
    assert K.mean_vectors(spark.createDataFrame(_rows(), SCHEMA), vectors).filter("size(vec) > 0").count() == 0
    monkeypatch.setattr(K, "MAX_SYMBOLS", 5)
    with pytest.raises(ValueError, match="more than 5 symbols"):
        K.factorise(pairs, 4)
