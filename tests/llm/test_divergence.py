"""Divergence of sources against sums over all terms."""

import random
import re
from collections import Counter, defaultdict

from doclens.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string, term string, n int, value string"


def brute(rows, least, top):
    out = []
    docs = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for la, so, t in rows]
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = defaultdict(Counter)
        for _, source, words in mine:
            counts[source].update(w for w in words if w in kept)

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        p = {source: shares(c) for source, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for a in counts:
            pairs = [(b, sum((p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t]) for t in kept)) for b in counts if b != a]
            words = [(t, (p[a][t] - q[t]) ** 2 // (p[a][t] + q[t])) for t in kept if counts[a][t] and p[a][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", words, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, a, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def found(spark, rows, **kinds):
    frame = spark.createDataFrame([(i, *row, "x", 1, "y") for i, row in enumerate(rows)], SCHEMA)
    made = divergence.divergence(frame, **kinds)
    return sorted(tuple(r) for r in made.select("lang", "source", "part", "item", "value", "rank").collect())


def random_rows(n, seed):
    pick = random.Random(seed)
    words = ["the", "The", "été", "ÉTÉ", "x1y", "naïve", "中文", "a-b", "Zz", "k k", "𝒳"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for _ in range(n):
        source = pick.choice(["s1", "s2", "s3", "", None, "é"])
        rows.append((pick.choice(["en", "fr", None]), source, " ".join(pick.choices(words, k=pick.randrange(12)))))
    return rows + [("en", "s1", "the same text"), ("en", "s2", "the same text")] * 40 + [("xx", "lonely", "few"), ("xx", "other", None), ("en", "silent", "")]


def test_against_all_terms(spark):
    rows = random_rows(250, 1)
    assert found(spark, rows) == brute(rows, 10, 10)


def test_pairs_at_a_time(spark, monkeypatch):
    """Pair sums and counts that go on in many pieces are the same."""
    rows = random_rows(120, 2)
    monkeypatch.setattr(divergence, "PAIRS", 4)
    monkeypatch.setattr(divergence, "HELD", 7)
    monkeypatch.setattr(divergence, "TEXTS", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert found(spark, rows, least=2, top=3) == brute(rows, 2, 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_text_from_many_sources_and_a_long_one(spark):
    rows = [("en", f"s{i % 30}", "one text for all") for i in range(600)] + [("en", "s0", "long " * 200_000)] * 10
    assert found(spark, rows) == brute(rows, 10, 10)


def test_no_kept_terms_and_nothing(spark):
    rows = [("en", "a", "x"), ("en", "b", "y"), ("en", "c", None)]
    assert {r[4] for r in found(spark, rows)} == {0} and len(found(spark, rows)) == 6
    assert found(spark, []) == []
