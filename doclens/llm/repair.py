"""Conversation structure repair: the cheapest edits that make roles alternate, by a checkpointed DP.

Roles after repair read ``(s?(ua)+)?`` by their initials. Four states know all that matters of what was
written: nothing yet, a system turn, a user turn, an assistant turn. From the end of a conversation
backwards the least cost of the rest is four numbers per row. Only those at the checkpoints, one per
block of about the square root of the longest conversation, are stored; inside a block they are
recomputed while the block is walked forward and the tight edit of least letter is taken. Letter and
state tell the next state, so the walk gives the least of all cheapest edit strings.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.llm.common import WHITE, read, ships
from doclens.operators.numbering import row_numbers
from doclens.session import written

ships(__name__)

# Fixed values of the cost model: Rerole, Delete, Insert, and a truncated turn that stays.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
# Fewest rows of a block.
BLOCK = 64
_FAR = 1 << 40
# States: 0 nothing, 1 system, 2 user, 3 assistant. By state: the state after the role that comes next.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
# By role initial (s, u, a, any other) and state: the state after the row is kept, None if it cannot be.
_KEEP = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
_END = (0, 2 * INSERT, INSERT, 0)


def _own(code: int, copies: int, state: int, after: tuple) -> list[tuple[str, int, int]]:
    """(letter, cost to the end, next state) of the edits of a row, in the order of their letters. A code
    is three times the place of the initial plus 0, 1 for truncated, 2 for a row that must go; further
    copies of the row are duplicates and go."""
    initial, fault = divmod(code, 3)
    more = DELETE * (copies - 1)
    edits = [("D", DELETE + more + after[state], state)]
    if fault < 2:
        stays = CUT * fault + more
        kept = _KEEP[initial][state]
        if kept is not None:
            edits.append(("K", stays + after[kept], kept))
        edits.append(("R", REROLE + stays + after[_NEXT[state]], _NEXT[state]))
    return edits


def _before(code: int, copies: int, after: tuple) -> tuple:
    """Least cost to the end by state before a row, from that after it. Inserted turns come first; two in
    a row lead back, so one round of them between user and assistant is enough."""
    v0, v1, v2, v3 = (min(cost for _, cost, _ in _own(code, copies, state, after)) for state in range(4))
    u, a = min(v2, INSERT + v3), min(v3, INSERT + v2)
    return min(v0, INSERT + u), min(v1, INSERT + u), u, a


def backward(rows: list[dict], end: tuple) -> list[tuple]:
    """The state costs before each row of a block, and those after it last."""
    costs = [tuple(end)]
    for row in reversed(rows):
        costs.append(_before(row["code"], row["copies"], costs[-1]))
    return costs[::-1]


def walk(rows: list[dict], costs: list[tuple], state: int, last: bool):
    """The edits of each row from a state on: ((letters, roles, own place in the roles, -1 if deleted)
    per row, state after the block). A kept role is None. Turns inserted after the last row are its."""
    made = []
    for row, here, after in zip(rows, costs, costs[1:]):
        letters, roles, own = "", [], -1
        while True:
            tight = {letter: to for letter, cost, to in _own(row["code"], row["copies"], state, after) if cost == here[state]}
            if "D" not in tight and here[state] == INSERT + here[_NEXT[state]]:
                letters += "I"
                roles.append(_ROLE[state])
                state = _NEXT[state]
                continue
            letter = min(tight)
            if letter != "D":
                own = len(roles)
                roles.append(None if letter == "K" else _ROLE[state])
            letters += letter + "D" * (row["copies"] - 1)
            state = tight[letter]
            break
        made.append((letters, roles, own))
    while last and made and state in (1, 2):
        letters, roles, own = made[-1]
        made[-1] = letters + "I", [*roles, _ROLE[state]], own
        state = _NEXT[state]
    return made, state


# --- blocks on Spark ---


def _rows_out(names: list[str], kinds: list, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By state before and after: the least cost of each block."""
    for batch in batches:
        rows = []
        for conv, block, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            ends = [tuple(0 if q == to else _FAR for q in range(4)) for to in range(4)]
            rows.append((conv, block, [cost for end in ends for cost in backward(members, end)[0]]))
        yield _rows_out(["_conv", "_block", "span"], [pa.string(), pa.int64(), pa.list_(pa.int64())], rows)


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """State costs at the end of each block, from the spans of all blocks of a conversation."""
    for batch in batches:
        rows = []
        for conv, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            end = _END
            for number, span in enumerate(reversed(spans)):
                rows.append((conv, span["_block"], list(end), number == 0))
                end = tuple(min(span["span"][4 * to + q] + end[to] for to in range(4)) for q in range(4))
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
        yield _rows_out(["_conv", "_block", "end", "last"], kinds, rows)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By state at the start of a block: the state after it."""
    for batch in batches:
        rows = []
        for conv, block, members, end, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            costs = backward(members, tuple(end))
            exits = [walk(members, costs, q, last)[1] if costs[0][q] < _FAR else q for q in range(4)]
            rows.append((conv, block, exits))
        yield _rows_out(["_conv", "_block", "exits"], [pa.string(), pa.int64(), pa.list_(pa.int32())], rows)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            state = 0
            for block in blocks:
                rows.append((conv, block["_block"], state))
                state = block["exits"][state]
        yield _rows_out(["_conv", "_block", "entry"], [pa.string(), pa.int64(), pa.int32()], rows)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits per row: the state costs of the block recomputed, then the walk."""
    names = ["_conv", "pos", "edits", "roles", "own"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32()]
    for batch in batches:
        rows = []
        for conv, members, end, last, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            made, _ = walk(members, backward(members, tuple(end)), entry, last)
            rows.extend((conv, row["pos"], *edits) for row, edits in zip(members, made, strict=True))
        yield _rows_out(names, kinds, rows)


def _codes(numbered: DataFrame) -> DataFrame:
    """(_conv, pos, copies, fault, code): what the repair must know of a row, without its text."""
    marks = [F.xxhash64("role", "text").alias("_a"), F.xxhash64(F.lit(1), "role", "text").alias("_b")]
    firsts = numbered.groupBy("_conv", *marks).agg(F.min("pos").alias("pos")).select("_conv", "pos", F.lit(True).alias("_first"))
    bare = F.rtrim("text", F.lit(WHITE))
    fault = (
        F.when(bare == "", "blank").when(F.col("_first").isNull(), "duplicate")
        .when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated")
    )
    place = F.when(F.col("fault").isin("blank", "duplicate"), 2).when(F.col("fault") == "truncated", 1).otherwise(0)
    initial = F.substring("role", 1, 1)
    first = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    marked = numbered.join(firsts, ["_conv", "pos"], "left").withColumn("fault", fault)
    return marked.select("_conv", "pos", "copies", "fault", (3 * first + place).alias("code"))


def repair(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """The cheapest repair of each conversation, a row per turn: conv, ``pos`` (from 1), turn, ``initial``
    of its role, ``copies``, ``fault`` (blank, duplicate, truncated or null), ``edits`` and ``messages``.

    ``edits`` are the letters of the turns inserted before it (I), of its own edit (Keep, Rerole,
    Delete), of its further copies (D) and, for the last row, of those inserted after it. ``messages``
    is what these make: an array of (role, text). Joined over ``pos`` they are the audit and the
    repaired conversation. Costs: Rerole 3, Delete 4, Insert 3, a truncated turn that stays 3; blank
    and duplicate turns must go. Of the cheapest edits those with the ASCII-least letters are taken.

    Order: turn (nulls first), role, text. Equal rows are one row with its number of ``copies``, so a
    row repeated without end is one row. A null role or text is one space; a null conv is a
    conversation of its own. Other columns are not read; no rows in, no rows out.

    A conversation of any length is spread over tasks: positions come from slices by range, and a task
    sees a block of at most ``block`` rows, or the square root of the longest conversation, or four by
    four costs for each block of a conversation, as many. Texts are not part of any of it.
    """
    spark = turns.sparkSession
    rows = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("n")).alias("_conv"),
        F.col(turn).alias("turn"), _spaced(F.col(role)).alias("role"), _spaced(F.col(text)).alias("text"),
    )
    distinct = rows.groupBy("_conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("turn"), F.col("role"), F.col("text")]
    numbered = written(row_numbers(distinct, order, ["_conv"], "pos"), "turns")
    codes = written(_codes(numbered), "codes")
    longest = codes.agg(F.max("pos")).first()[0] or 0
    block = max(block, math.isqrt(longest) + 1)
    members = F.sort_array(F.collect_list(F.struct("pos", "code", "copies"))).alias("rows")
    at = F.floor((F.col("pos") - 1) / block).alias("_block")
    blocks = written(codes.groupBy("_conv", at).agg(members), "blocks")

    # Conversations of one block need no checkpoint; those of exactly one full block are taken along.
    long = blocks.filter((F.col("_block") > 0) | (F.size("rows") == block))
    spans = long.mapInArrow(_spans, "_conv string, _block bigint, span array<bigint>")
    spans = spans.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_block", "span"))))
    ends = written(spans.mapInArrow(_checkpoints, "_conv string, _block bigint, end array<bigint>, last boolean"), "ends")
    exits = long.join(ends, ["_conv", "_block"]).mapInArrow(_exits, "_conv string, _block bigint, exits array<int>")
    exits = exits.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_block", "exits"))))
    entries = exits.mapInArrow(_entries, "_conv string, _block bigint, entry int")

    known = blocks.join(ends, ["_conv", "_block"], "left").join(entries, ["_conv", "_block"], "left")
    known = known.select(
        "_conv", "rows", F.coalesce("end", F.array(*[F.lit(v).cast("bigint") for v in _END])),
        F.coalesce("last", F.lit(True)), F.coalesce("entry", F.lit(0)),
    )
    edits = known.mapInArrow(_edits, "_conv string, pos bigint, edits string, roles array<string>, own int")
    marked = codes.select("_conv", "pos", "fault").join(edits, ["_conv", "pos"])
    said = F.transform(
        "roles",
        lambda r, i: F.struct(
            F.coalesce(r, F.col("role")).alias("role"), F.when(i == F.col("own"), F.col("text")).otherwise("").alias("text")
        ),
    )
    own = F.when(F.col("_conv") != "n", F.expr("substring(_conv, 2)")).cast(turns.schema[conv].dataType)
    return numbered.join(marked, ["_conv", "pos"]).select(
        own.alias(conv), "pos", F.col("turn").alias(turn), F.substring("role", 1, 1).alias("initial"),
        "copies", "fault", "edits", said.alias("messages"),
    )


def _spaced(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(" "))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its rows in order, which pass by one at a time."""
    names = ["_key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    now, state = None, {}

    def made() -> tuple:
        turns, faults = state["turns"], state["faults"]
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        counts = [faults.get(name, 0) for name in ("blank", "duplicate", "truncated")]
        return now, gaps, *counts, state["illegal"], state["cost"], "".join(state["audit"]), state["digest"].hexdigest()

    for batch in batches:
        out = []
        for key, turn, initial, copies, fault, edits, messages in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not state or key != now:
                if state:
                    out.append(made())
                now = key
                state = {
                    "turns": [0, 0, 0], "faults": {}, "illegal": 0, "cost": 0, "audit": [],
                    "digest": hashlib.sha256(), "role": None, "said": False,
                }
            turns, faults = state["turns"], state["faults"]
            if turn is not None and (not turns[2] or turn != turns[1]):
                state["turns"] = [turns[0] if turns[2] else turn, turn, turns[2] + 1]
            if fault == "blank" or fault == "duplicate":
                faults[fault] = faults.get(fault, 0) + copies
            else:
                faults["duplicate"] = faults.get("duplicate", 0) + copies - 1
                faults["truncated"] = faults.get("truncated", 0) + (fault == "truncated")
            legal = state["role"] is None or state["role"] + initial in ("su", "ua", "au")
            state["illegal"] += (not legal) + copies - 1
            state["role"] = initial
            stays = fault == "truncated" and ("K" in edits or "R" in edits)
            costs = edits.count("R") * REROLE + edits.count("D") * DELETE + edits.count("I") * INSERT
            state["cost"] += costs + CUT * stays
            state["audit"].append(edits)
            for message in messages:
                piece = f"{message['role']}:{message['text']}"
                state["digest"].update((("\n" if state["said"] else "") + piece).encode("utf-8", "surrogatepass"))
                state["said"] = True
        yield _rows_out(names, kinds, out)
    if state:
        yield _rows_out(names, kinds, [made()])


def report(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    The rows of a conversation pass through one task in order, as a running SHA-256 asks; it keeps no
    row, only the letters of the audit, which are one value of the result. ``turn`` must be whole numbers."""
    found = repair(turns, conv, turn, role, text)
    key = F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("n"))
    rows = found.select(key.alias("_key"), "pos", F.col(turn).cast("bigint").alias("turn"), "initial", "copies", "fault", "edits", "messages")
    ordered = rows.repartition("_key").sortWithinPartitions("_key", "pos").drop("pos")
    schema = "_key string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    made = ordered.mapInArrow(_report, f"{schema}, audit string, repaired_sha256 string")
    own = F.when(F.col("_key") != "n", F.expr("substring(_key, 2)")).cast(turns.schema[conv].dataType)
    return made.select(own.alias(conv), *made.columns[1:])


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with faults put in by crc32 of ``conv_id:turn`` modulo 20:
    0 drops the row, 1 empties the text, 2 takes its ``[.!?]``, 3 repeats the row, 4 makes it the user's.
    Nulls are one space, in the hash as well; null ids and turns stay null."""
    key = F.concat(_spaced(F.col("conv_id")), F.lit(":"), _spaced(F.col("turn")))
    rows = turns.select("conv_id", "turn", _spaced(F.col("role")).alias("role"), _spaced(F.col("text")).alias("text"), (F.crc32(key) % 20).alias("_kind"))
    kind, body = F.col("_kind"), F.col("text")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(body, "[.!?]", "")).otherwise(body)
    times = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.filter(kind != 0).withColumn("_time", F.explode(times)).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")
    )


def query(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    found = report(damaged(rows))
    every = rows.select(F.col("conv_id").alias("_id")).distinct()
    joined = every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in found.columns[1:7]]
    empty = hashlib.sha256(b"").hexdigest()
    return joined.select(
        F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"),
    )


def _sql() -> str:
    """The same by recursion from the last row back: by state the least of cost, audit and text as one
    string, which sorts like (cost, audit)."""
    step = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    codes = "list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT))"
    crc = f"xor(list_reduce({codes}, lambda a, b: {step}), 4294967295)"
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def before(rest: str, cost: str, letter: str, piece: str = "NULL") -> str:
        text = f"substr({rest}, strpos({rest}, chr(1)) + 1)"
        after = f"CASE WHEN {piece} IS NULL THEN {text} WHEN {text} = '' THEN {piece} ELSE {piece} || chr(10) || {text} END"
        audit = f"substr({rest}, 13, strpos({rest}, chr(1)) - 13)"
        return f"lpad((left({rest}, 12)::BIGINT + {cost})::VARCHAR, 12, '0') || '{letter}' || {audit} || chr(1) || {after}"

    own = []
    for state in range(4):
        options = [before(f"k{state}", str(DELETE), "D")]
        stays = f"(CASE WHEN truncated THEN {CUT} ELSE 0 END)"
        made = before(f"k{_NEXT[state]}", f"{REROLE} + {stays}", "R", f"('{_ROLE[state]}:' || txt)")
        options.append(f"CASE WHEN NOT forced THEN {made} END")
        for initial, to in zip("sua", _KEEP):
            if to[state] is not None:
                kept = before(f"k{to[state]}", stays, "K", "(role || ':' || txt)")
                options.append(f"CASE WHEN NOT forced AND initial = '{initial}' THEN {kept} END")
        own.append(f"least({', '.join(options)}) AS o{state}")
    u = f"least(o2, {before('o3', str(INSERT), 'I', _piece('assistant'))})"
    a = f"least(o3, {before('o2', str(INSERT), 'I', _piece('user'))})"
    ahead = [f"least(o{q}, {before('u', str(INSERT), 'I', _piece('user'))}) AS k{q}" for q in (0, 1)]
    empty = "lpad('0', 12, '0') || chr(1)"
    ends = [f"{empty} AS k0", f"{before('e1', str(INSERT), 'I', _piece('user'))} AS k1", "e1 AS k2", f"{empty} AS k3"]
    return f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, {crc} % 20 AS kind FROM keyed),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt, copy) AS pos FROM dam),
marked AS (SELECT *, left(role, 1) AS initial, rtrim(txt, {white}) AS bare, lag(left(role, 1)) OVER w AS prior,
    row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY pos) > 1 AS again,
    count(*) OVER (PARTITION BY conv_id) AS n FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
rows_ AS (SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, bare = '' OR again AS forced,
    bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated FROM marked),
stats AS (SELECT conv_id, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM rows_ GROUP BY conv_id),
dp AS (
  SELECT conv_id, pos + 1 AS pos, {', '.join(ends)}
    FROM (SELECT *, {before(f"({empty})", str(INSERT), "I", _piece("assistant"))} AS e1 FROM rows_ WHERE pos = n)
  UNION ALL
  SELECT conv_id, pos, {', '.join(ahead)}, u AS k2, a AS k3 FROM (SELECT *, {u} AS u, {a} AS a FROM (
    SELECT r.conv_id, r.pos, {', '.join(own)}
    FROM dp JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.pos = dp.pos - 1))),
made AS (SELECT conv_id, left(k0, 12)::BIGINT AS cost, substr(k0, 13, strpos(k0, chr(1)) - 13) AS audit,
    sha256(substr(k0, strpos(k0, chr(1)) + 1)) AS digest FROM dp WHERE pos = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN made m ON m.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _piece(role: str) -> str:
    return f"'{role}:'"


SQL = _sql()
