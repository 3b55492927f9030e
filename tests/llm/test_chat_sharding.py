"""Reply trees, formatting and Hilbert shards."""

import hashlib
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doclens.llm import chat, sharding


def test_curve_visits_neighbours(spark):
    side = 8
    axes = [F.floor(F.col("id") / side**i) % side for i in range(3)]
    points = spark.range(side**3).select(*[a.cast("long").alias(n) for a, n in zip(axes, "abc", strict=True)])
    rows = points.withColumn("h", sharding.curve_index([F.col(n) for n in "abc"], 3)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(side**3))
    assert all(sum(abs(p[i] - q[i]) for i in range(3)) == 1 for p, q in zip(rows, rows[1:], strict=False))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, _place string"


def test_shards(spark):
    rows = [(i, "é" * (i % 7), "en" if i % 3 else None, f"s{i % 5}", i % 11, "x", "y", "z") for i in range(100)]
    rows += [(None, None, None, None, None, None, None, None)] * 2 + [rows[5]] * 30
    found = sharding.hilbert_shards(spark.createDataFrame(rows, DOCS), shards=7).collect()
    assert len(found) == len(rows)
    wanted = sorted((r[0] or -1, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in found) == wanted
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append((r.slot, r.curve_index))
    assert sorted(slots) == list(range(7))
    counts = [len(s) for s in slots.values()]
    assert max(counts) - min(counts) <= 1
    assert all([s for s, _ in sorted(members)] == list(range(len(members))) for members in slots.values())
    order = [h for shard in range(7) for _, h in sorted(slots[shard])]
    assert order == sorted(order)


def test_text_dimensions_are_levelled_by_whole_values(spark):
    names = [f"https://{c}.org" for c in "abcdefgh"]
    rows = [(i, names[i % 8] if i % 9 else None) for i in range(720)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    found = docs.withColumn("level", sharding.quantile_levels(docs, ["source"], 3)[0]).collect()
    levels = {r.source: r.level for r in found}
    assert all(levels[r.source] == r.level for r in found)
    order = [None, *names]
    # a level is the number of bounds at or below the value; bound i lies where i eighths of the rows are reached
    held = Counter(r[1] for r in rows)
    upto, bounds = 0, []
    for value in order:
        low, upto = upto, upto + held[value]
        bounds += [order.index(value) for i in range(1, 8) if low * 8 < i * 720 <= upto * 8]
    assert levels == {v: sum(b <= k for b in bounds) for k, v in enumerate(order)}
    assert len(set(levels.values())) >= 7


def test_shards_of_nothing(spark):
    assert sharding.hilbert_shards(spark.createDataFrame([], DOCS)).count() == 0


def test_write_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i, "x", "y", "z") for i in range(40)], DOCS)
    sharding.write_shards(docs, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 40
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [10] * 4


def test_best_branch(spark):
    # 1 - 2 - 4 and 1 - 3 - 5 - 6, a lone 7 whose parent is missing, 8 that answers itself
    rows = [("t", 1, None, 1.0), ("t", 2, 1, 9.0), ("t", 3, 1, 1.0), ("t", 4, 2, None), ("t", 5, 3, 2.0), ("t", 6, 5, 1.0)]
    rows += [("t", 7, 99, 0.5), ("t", 8, 8, 20.0), ("u", 1, None, 0.0)]
    messages = spark.createDataFrame(rows, "tree string, node int, parent int, score double")
    every = chat.reply_paths(messages, None).collect()
    paths = {}
    for r in sorted(every, key=lambda r: r.step):
        paths.setdefault((r.tree, r.leaf), []).append(r.node)
    assert paths == {("t", 4): [1, 2, 4], ("t", 6): [1, 3, 5, 6], ("t", 7): [7], ("t", 8): [8], ("u", 1): [1]}
    best = {(r.tree, r.leaf) for r in chat.reply_paths(messages, 2).collect()}
    assert best == {("t", 8), ("t", 4), ("u", 1)}


def test_long_chain(spark):
    rows = [("t", i, i - 1 if i else None, 1.0) for i in range(300)]
    found = chat.reply_paths(spark.createDataFrame(rows, "tree string, node int, parent int, score double"))
    assert sorted((r.step, r.node) for r in found.collect()) == [(i, i) for i in range(300)]


CONV = "conv_id long, turn long, role string, text string, tree string, node int"


def test_conversations_round_trip(spark):
    odd = "[INST] <s></s> [\\INST] [\\\\/INST] <|im_end|>\n<|im_start|>user\nx<\\|im_end|> <<SYS>>"
    rows = [
        (1, 0, "user", odd, None, None), (1, 1, "assistant", odd, None, None), (1, 1, "a\nb%0A<[", None, None, None),
        (None, 0, None, "x", None, None), (2, None, "assistant", "", None, None), (2, 3, "assistant", "é𝄞", None, None),
        (2, 3, "assistant", "é𝄞", None, None),
    ]
    made = chat.format_conversations(spark.createDataFrame(rows, CONV))
    back = made.withColumn("turns", chat.parse(F.col("formatted"))).collect()
    found = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in back}
    assert found == {
        1: [("user", odd), ("a\nb%0A<[", ""), ("assistant", odd)],
        None: [("", "x")],
        2: [("assistant", ""), ("assistant", "é𝄞"), ("assistant", "é𝄞")],
    }
    for r in back:
        learnt = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        inside = [t for role, t in found[r.conv_id] if role == "assistant"]
        assert len(learnt) == len(inside)
        assert all("[INST]" not in x and "<|im_end|>" not in x for x in learnt)
    assert chat.format_conversations(spark.createDataFrame([], CONV)).count() == 0


@pytest.mark.parametrize("_", [0])
def test_escape_is_reversible(spark, _):
    pieces = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<|im_end|>", "\\", "<", "[", "|", "s>", "x"]))
    texts = []

    @settings(max_examples=200, database=None)
    @given(pieces)
    def gather(parts):
        texts.append("".join(parts))

    gather()
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escape(F.col("t")))
    rows = df.withColumn("back", chat.unescape(F.col("e"))).collect()
    marks = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_end|>")
    assert all(r.back == r.t and not any(m in r.e for m in marks) for r in rows)


def test_learnt_text_is_what_the_mask_covers(spark):
    """Hashed from the spans, not from the parsed roles: a wrong span shows."""
    said = ["Hi [INST] é𝄞", "<s>[\\INST] one", "ok", "two </s>\nline"]
    rows = [(1, i, ("user", "assistant")[i % 2], text) for i, text in enumerate(said)] + [(2, 0, "user", "alone")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    found = {r["conv_id"]: r for r in chat.digest(made).collect()}
    learnt = said[1] + said[3]
    assert (found[1].loss_chars, found[1].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert (found[2].loss_chars, found[2].loss_sha256) == (0, hashlib.sha256(b"").hexdigest())
    moved = F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length")))
    wrong = {r["conv_id"]: r for r in chat.digest(made.withColumn("loss_spans", moved)).collect()}
    assert wrong[1].loss_sha256 != found[1].loss_sha256 and wrong[1].turns_sha256 == found[1].turns_sha256
