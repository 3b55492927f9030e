"""Language network, toxicity model and benchmark search."""

import base64
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from doclens.llm import decontaminate, language, toxicity


def test_backpropagation_matches_differences():
    net = language.fresh(["a", "b", "c"], 3, 1)
    for group in (net.x, net.u, net.v):
        for i, p in enumerate(group):
            group[i] = p.astype(np.float64)
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    rng = np.random.default_rng(0)
    windows = rng.integers(97, 102, (4, 6)).astype(np.int16)
    windows[1, 4:] = language.PAD
    labels = np.array([0, 1, 2, 1])
    _, found = language.gradients(net, windows, labels)
    for p, g in zip(net.parameters(), found, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-3
        high = language.gradients(net, windows, labels)[0]
        p[at] = old - 1e-3
        low = language.gradients(net, windows, labels)[0]
        p[at] = old
        assert abs((high - low) / 2e-3 - g[at]) < 0.02 * abs(g[at]) + 1e-4


def test_fast_states_match_the_training_step():
    net = language.fresh(["a", "b"], 4, 2)
    windows = np.random.default_rng(1).integers(0, 257, (5, language.WINDOW)).astype(np.int16)
    both = language.states(net, windows)
    for side in range(2):
        h = np.zeros((5, 4), np.float32)
        for t in range(language.WINDOW) if side == 0 else reversed(range(language.WINDOW)):
            h = language._step(h, net.x[side][windows[:, t]], net.u[side], net.v[side])[0]
            assert np.allclose(both[side, t], h, atol=1e-5)


ALPHABETS = {"xx": "abc def ", "yy": "uvw xyz "}


def _say(lang, n, rng):
    return "".join(rng.choice(ALPHABETS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def net():
    rng = random.Random(3)
    return language.fit([(_say(lang, 300, rng), lang) for lang in ALPHABETS for _ in range(30)], steps=60)


def test_language_of_odd_texts(spark, net):
    rng = random.Random(4)
    long = _say("yy", 400_000, rng)
    rows = [(1, _say("xx", 200, rng), "yy", 9.0), (2, long, None, None), (3, None, "xx", None), (4, "", "xx", None)]
    rows += [(5, "12 &&& %%", "xx", 0.1), (None, "abcde", None, None), (1, "uvwxyz", "xx", 0.2), (1, "uvwxyz", "xx", 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    found = sorted((r.doc_id or 0, r.lang_pred, 0 <= r.score <= 1) for r in language.predict(docs, net).collect())
    assert found == [
        (0, "xx", True), (1, "xx", True), (1, "yy", True), (1, "yy", True), (2, "yy", True), (3, "und", True),
        (4, "und", True), (5, "und", True),
    ]
    kept = language.accepted(docs, net)
    assert kept.columns == docs.columns and kept.count() == 5
    assert language.predict(docs.limit(0), net).count() == 0


def test_every_byte_counts(net):
    rng = random.Random(5)
    parts = [_say(lang, n, rng) for lang, n in (("xx", 300_000), ("yy", 500_000), ("xx", 70), ("yy", 130))]
    text = parts[0] + parts[1]
    names, scores = language.pooled(net, pa.array([text, parts[2], None, parts[3]]))
    assert names == ["yy", "xx", "und", "yy"]
    assert abs(scores[0] - 5 / 8) < 0.05


def test_no_labelled_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "1", None)], "doc_id long, text string, lang string")
    empty = language.fit(language.labelled_sample(docs))
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}
    assert [r.doc_id for r in language.accepted(docs, empty).collect()] == [1]


def test_junk_is_rejected_and_sound_texts_are_not(spark):
    """Planted junk with letters goes; clean texts with repeated or quoted passages stay."""
    rng = random.Random(11)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 500")
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(120).collect() if r["text"]]
    junk = [base64.b64encode(rng.randbytes(rng.randint(60, 3000))).decode() for _ in range(20)]
    junk += [rng.randbytes(rng.randint(60, 3000)).hex(" ") for _ in range(20)]
    junk += ["".join(f'<td class="c{rng.randrange(9)}">{rng.randrange(999)}</td>' for _ in range(30)) for _ in range(20)]
    junk += ["\n".join(f"x{i},{rng.random():.4f},{rng.random():.6f}" for i in range(40)) for _ in range(20)]
    junk += ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(200)) for _ in range(20)]
    junk += ["".join(rng.choice("оеаинтсрвлкмдпуяыьг ") for _ in range(300)) for _ in range(20)]
    sound = [t[:300] + " " + (" ".join(t.split()[2:6]) + " ") * 60 for t in texts]
    sound += [a[:400] + "\n" + b[:400] for a, b in zip(texts, reversed(texts), strict=True)]
    planted = [(10_000 + i, t) for i, t in enumerate(junk)] + [(20_000 + i, t) for i, t in enumerate(sound)]
    extra = spark.createDataFrame(planted, "doc_id long, text string")
    rows = docs.unionByName(extra, allowMissingColumns=True)
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, rows, "").select("doc_id").collect()}
    assert sum(10_000 <= k < 20_000 for k in kept) <= 0.02 * len(junk)
    assert sum(k >= 20_000 for k in kept) >= 0.98 * len(sound)
    assert sum(k < 10_000 for k in kept) >= 0.998 * docs.count()


def test_held_out_languages(spark):
    found = language.query(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r.lang_pred == truth[r.doc_id] for r in found if r.held_out and truth[r.doc_id]]
    assert len(found) == len(truth) and np.mean(held) > 0.98


def test_toxicity(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    bad = ["vile", "foul", "nasty"]

    def text(label):
        body = rng.choices(words, k=60)
        for _ in range(3 * label):
            body.insert(rng.randrange(60), rng.choice(bad))
        return " ".join(body)

    rows = [(text(label), label) for label in (0, 1) for _ in range(150)]
    model = toxicity.fit(rows, bits=16)
    assert 0 < len(model.slots) < 2000
    fresh = [(i, text(i % 2), 0.9) for i in range(60)] + [(100, None, None), (101, "", None), (None, "vile " * 50_000, None)]
    docs = spark.createDataFrame(fresh + [fresh[1]], "doc_id long, text string, score double")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert np.mean([(scores[i] >= 0.5) == (i % 2) for i in range(60)]) > 0.95
    assert scores[100] == scores[101] and all(0 <= s <= 1 for s in scores.values())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_with_one_label_or_none(spark):
    assert toxicity.fit([]).bias == 0 and toxicity.fit([("a", 1)]).bias > 0 > toxicity.fit([("a", 0)]).bias
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 0), (3, 7)], "doc_id long, toxic int")
    assert toxicity.labelled_sample(docs, labels) == [("a", 1)]


def _brute(docs, items, threshold=0.8, width=5):
    def shingles(text):
        w = decontaminate.words(text)
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}

    sets = [(key, shingles(text)) for key, text in items]
    return sorted(
        (doc if doc is not None else -1, key)
        for doc, text in docs
        for key, item in sets
        if item and len(item & shingles(text)) >= threshold * len(item) - 1e-9
    )


def test_containment_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([3, 5, 6, 9, 12, 20, 40, 41, 80])]
    items += [(50, None), (51, ""), (7, "W1, w2; w3 -- w4 w5")]
    docs = []
    for i in range(120):
        body = rng.choices(words, k=rng.choice([0, 4, 50, 400]))
        if i % 2:
            passage = rng.choice(items)[1] or ""
            cut = passage.split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                if cut:
                    cut[rng.randrange(len(cut))] = "zzz"
            at = rng.randrange(len(body) + 1)
            body[at:at] = cut
        docs.append((i, " ".join(body).upper() if i % 3 else " ".join(body)))
    docs += [(None, items[6][1]), (500, None), (501, ""), docs[1], docs[1]]
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, containment string")
    b = spark.createDataFrame(items, "item_id long, text string")
    wanted = _brute(docs, items)
    for block in (1000, 4):
        found = decontaminate.contained_items(d, b, block=block).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in found) == wanted
    hit = {k for k, _ in wanted}
    kept = decontaminate.without_items(d, b, block=4)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in docs if (k if k is not None else -1) not in hit)
    assert decontaminate.contained_items(d, b.limit(0)).count() == 0
    assert decontaminate.contained_items(d.limit(0), b).count() == 0


def test_short_items_and_scripts_without_spaces(spark):
    """Whole items of three and four words, and items of characters; shorter ones are listed as unmatched."""
    items = [(1, "Name the capital"), (2, "who wrote Don Quixote"), (3, "Paris"), (4, "two words"), (5, None)]
    items += [(6, "日本の首都はどこですか"), (7, "中国"), (8, "เมืองหลวงของไทยคือ"), (9, "one two three four five six")]
    docs = [(1, "Please name the capital!"), (2, "He asked WHO wrote Don Quixote then"), (3, "Paris is two words")]
    docs += [(4, "name the big capital"), (5, "問題、日本の首都はどこですか。東京です"), (6, "中国は日本の隣"), (7, "ก เมืองหลวงของไทยคือ กรุงเทพ")]
    docs += [(8, "say one two three four five six now"), (9, "日本の首都"), (10, None), (11, "wrote Don Quixote")]
    d, b = (spark.createDataFrame(rows, f"{key} long, text string") for rows, key in ((docs, "doc_id"), (items, "item_id")))
    for block in (1000, 2):
        found = decontaminate.contained_items(d, b, short=True, block=block).collect()
        hits = {(r.doc_id, r.item_id) for r in found if r.containment is not None}
        assert hits == {(1, 1), (2, 2), (5, 6), (7, 8), (8, 9)}
        assert sorted(r.item_id for r in found if r.containment is None and r.doc_id is None) == [3, 4, 5, 7]
        kept = {r.doc_id for r in decontaminate.without_items(d, b, short=True, block=block).collect()}
        assert kept == {3, 4, 6, 9, 10, 11}


@pytest.mark.parametrize("kind", ["int", "decimal(20,2)", "string", "date"])
def test_keys_of_any_type(spark, kind):
    cast = f"cast(date_add(date'2020-01-01', cast(id as int)) as {kind})" if kind == "date" else f"cast(id as {kind})"
    docs = spark.range(3).selectExpr(f"{cast} AS doc_id", "'one two three four five six' AS text")
    items = spark.range(2).selectExpr(f"{cast} AS item_id", "if(id = 0, 'two three four five six', 'no') AS text")
    found = decontaminate.contained_items(docs, items, short=True)
    assert [found.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")] == [kind, kind]
    names = [r[0] for r in docs.select("doc_id").collect()]
    rows = [(r.doc_id, r.item_id, r.containment) for r in found.collect()]
    assert sorted(rows, key=str) == sorted([(n, names[0], 1.0) for n in names] + [(None, names[1], None)], key=str)


def test_items_are_cut_into_blocks_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    items = spark.range(12).selectExpr("id AS item_id", "concat('a', id, ' b c d e', id) AS text")
    docs = spark.range(12).selectExpr("id AS doc_id", "concat('x a', id, ' b c d e', id, ' y') AS text")
    indexes = list(decontaminate._indexes(items, 1000, 0.8, 5, False))
    assert len(indexes) >= 4 and sum(len(i.names) for i in indexes) == 12
    found = decontaminate.contained_items(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(12)]


def test_labelled_sample_takes_the_smallest_hashes_and_whole_texts(spark):
    long = "".join(chr(97 + i // 4000) for i in range(80_000))
    rows = [(i, long if i == 7 else f"t{i}", ("a", "b", None)[i % 3]) for i in range(300)] + [(None, "x", "a"), (301, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(11)
    hashes = dict(map(tuple, docs.selectExpr("doc_id", "xxhash64(doc_id)").collect()))
    text = {r[0]: r[1] for r in rows}
    wanted = []
    for lang in "ab":
        ids = sorted((r[0] for r in rows if r[2] == lang and r[0] is not None and r[1]), key=lambda k: (hashes[k], k))
        wanted += [(text[k], lang) for k in ids[:9]]
    assert language.labelled_sample(docs, sample=9) == wanted
    found = [t for t, _ in language.labelled_sample(docs, sample=400, span=3200) if t[0] != "t"]
    assert found == [language.spread(long, 3200)] and len(found[0]) == 3200
    assert set(found[0]) == set(long) and found[0].startswith("a") and found[0].endswith(long[-1])


def test_toxicity_sample_takes_the_smallest_hashes(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('t', id) AS text").repartition(7)
    labels = spark.range(400).selectExpr("id AS doc_id", "cast(id % 3 AS int) AS toxic")
    hashes = dict(map(tuple, docs.selectExpr("doc_id", "xxhash64(doc_id)").collect()))
    wanted = []
    for label in (0, 1):
        wanted += [(hashes[k], f"t{k}", label) for k in sorted((k for k in range(400) if k % 3 == label), key=hashes.get)[:20]]
    assert toxicity.labelled_sample(docs, labels, sample=20) == [(t, label) for _, t, label in sorted(wanted)]
