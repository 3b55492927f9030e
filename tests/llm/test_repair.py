"""Conversation repair against all edit sequences and against one block for the whole conversation."""

import hashlib
import random
import re
import zlib
from functools import lru_cache
from itertools import product

import pytest

from doclens.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, _conv string, pos int, code string"
COST = {"K": 0, "R": 3, "D": 4, "I": 3}


def faults(rows):
    """Fault of each (role, text)."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(repair.WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def every_repair(rows):
    """Least (cost, letters, messages) over all edit sequences with at most two inserts between rows."""
    ins = [p for n in range(3) for p in product(("user", "assistant"), repeat=n)]
    choices = []
    for (role, text), fault in zip(rows, faults(rows), strict=True):
        cut = 3 * (fault == "truncated")
        own = [(4, "D", [])]
        if fault not in ("blank", "duplicate"):
            own += [(cut, "K", [(role, text)])] + [(3 + cut, "R", [(r, text)]) for r in ("user", "assistant")]
        choices.append([(c + 3 * len(p), "I" * len(p) + s, [(r, "") for r in p] + m) for p in ins for c, s, m in own])
    choices.append([(3 * len(p), "I" * len(p), [(r, "") for r in p]) for p in ins])
    best = None
    for chosen in product(*choices):
        key = sum(c for c, _, _ in chosen), "".join(s for _, s, _ in chosen)
        if best is not None and key >= best[:2]:
            continue
        made = [m for _, _, ms in chosen for m in ms]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in made)):
            best = *key, made
    return best


def least(rows):
    """The same by recursion, for long conversations."""
    marks = faults(rows)

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(3 + c, "I" + s) for c, s in [best(i, repair._NEXT[state], inserts + 1)]] if inserts < 2 else []
        if i == len(rows):
            return min(found + [(0, "")] * (state in (0, 3)), default=(1 << 30, ""))
        cut = 3 * (marks[i] == "truncated")
        c, s = best(i + 1, state, 0)
        found.append((4 + c, "D" + s))
        if marks[i] not in ("blank", "duplicate"):
            c, s = best(i + 1, repair._NEXT[state], 0)
            found.append((3 + cut + c, "R" + s))
            place = "sua".find(rows[i][0][:1] or "-")
            kept = None if place < 0 else repair._KEEP[place][state]
            if kept is not None:
                c, s = best(i + 1, kept, 0)
                found.append((cut + c, "K" + s))
        return min(found, default=(1 << 30, ""))

    return best(0, 0, 0)


def test_all_edit_sequences(spark):
    pick = random.Random(7)
    roles, texts = ["system", "user", "assistant", "tool", "", None], ["Hi.", "Ho", " ", "", "Hi?  ", "x!\n", None]
    convs = {c: [(pick.choice(roles), pick.choice(texts)) for _ in range(1 + c % 3)] for c in range(36)}
    rows = [(c, t, r, x, "a", 1, "b") for c, said in convs.items() for t, (r, x) in enumerate(said)]
    found = {r["conv_id"]: r for r in repair.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    for conv, said in convs.items():
        plain = [(r if r is not None else " ", x if x is not None else " ") for r, x in said]
        cost, audit, made = every_repair(plain)
        row, marks = found[conv], faults(plain)
        assert (row.cost, row.audit) == (cost, audit), plain
        assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
        assert (row.blank, row.duplicate, row.truncated) == tuple(marks.count(n) for n in ("blank", "duplicate", "truncated"))
        pairs = zip(plain, plain[1:], strict=False)
        assert row.illegal == sum((a[0][:1] or "-") + (b[0][:1] or "-") not in ("su", "ua", "au") for a, b in pairs)
        assert row.gaps == 0


def test_long_conversations_in_blocks(spark):
    pick = random.Random(3)
    roles, texts = ["system", "user", "user", "assistant", "assistant", "tool"], ["Yes.", "No", "", "Why?"]
    convs = {c: [(pick.choice(roles), f"{t} {pick.choice(texts)}" if pick.random() < 0.8 else pick.choice(texts)) for t in range(n)]
             for c, n in enumerate([63, 64, 65, 200, 4, 1])}
    rows = [(c, 2 * t, r, x, "a", 1, "b") for c, said in convs.items() for t, (r, x) in enumerate(said)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = {r["conv_id"]: r for r in repair.report(frame).collect()}
    for conv, said in convs.items():
        assert (found[conv].cost, found[conv].audit) == least(said)
        assert found[conv].gaps == len(said) - 1
    small = {}
    for r in repair.repair(frame, block=4).orderBy("conv_id", "pos").collect():
        small[r["conv_id"]] = small.get(r["conv_id"], "") + r["edits"]
    assert small == {conv: row.audit for conv, row in found.items()}


def test_copies_and_nulls(spark):
    rows = [(1, 0, "user", "Hi.", "a", 1, "b")] * 500 + [(1, 1, "assistant", "Ho.", "a", 1, "b")]
    rows += [(None, None, "user", "A.", None, None, None), (None, 5, "assistant", "B.", None, None, None), (None, 9, None, None, None, None, None)]
    rows += [(2, None, None, None, None, None, None)]
    found = {r["conv_id"]: r for r in repair.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[1].audit == "K" + "D" * 499 + "K" and found[1].cost == 4 * 499
    assert (found[1].duplicate, found[1].illegal, found[1].gaps) == (499, 499, 0)
    assert (found[None].audit, found[None].blank, found[None].gaps) == ("KKD", 1, 3)
    assert (found[2].audit, found[2].gaps, found[2].cost) == ("D", 0, 4)
    row = repair.repair(spark.createDataFrame(rows, SCHEMA)).filter("conv_id = 1 AND pos = 1").first()
    assert (row.copies, row.fault, [tuple(m) for m in row.messages]) == (500, None, [("user", "Hi.")])


def test_nothing(spark):
    assert repair.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_conversation_of_many_rows(spark):
    """A conversation that is all of the table: blocks of the square root of its length."""
    said = spark.range(20_000).selectExpr(
        "1L AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id, '.') AS text"
    )
    row = repair.report(said).first()
    assert row.audit == "K" * 20_000 and row.cost == row.illegal == row.gaps == 0


@pytest.mark.parametrize("conv,turn", [(1, 2), (None, 3), (-4, None)])
def test_damage(spark, conv, turn):
    rows = spark.createDataFrame([(conv, turn, None, "One. Two?")], "conv_id long, turn long, role string, text string")
    kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    one = (conv, turn, "user" if kind == 4 else " ", "" if kind == 1 else "One Two" if kind == 2 else "One. Two?")
    wanted = [] if kind == 0 else [one, one] if kind == 3 else [one]
    assert [tuple(r) for r in repair.damaged(rows).collect()] == wanted
