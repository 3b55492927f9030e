"""Conversations from reply trees. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.llm.common import read
from doclens.session import written

# The marks of a turn, and the control strings that common templates use.
START, END = "<|im_start|>", "<|im_end|>"
# <s> </s> [INST] [/INST] <|im_start|> <|im_end|> <<SYS>> <</SYS>>, the first character apart.
_OPEN = r"([<\[])"
_REST = r"(/?s>|/?INST\]|\|im_start\|>|\|im_end\|>|/?SYS>>)"


def escape(text: Column) -> Column:
    """Put one more backslash after the first character of each control string.

    ``[INST]`` becomes ``[\\INST]`` and ``[\\INST]`` becomes ``[\\\\INST]``: no control string
    is left, and taking one backslash away again restores every text.
    """
    return F.regexp_replace(text, rf"{_OPEN}(\\*){_REST}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"{_OPEN}\\(\\*){_REST}", "$1$2$3")


# A role stands before the first newline of its turn, so the newline is escaped as well.
_ROLE = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"), ("[", "%5B"))


def escape_role(role: Column) -> Column:
    for plain, code in _ROLE:
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in reversed(_ROLE):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


def reply_paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """The nodes of the best root-to-leaf paths: ``tree``, ``leaf``, ``node``, ``step`` (0 = root).

    ``messages`` has ``tree``, ``node`` (unique in its tree), ``parent`` and ``score``. A path's
    score is the sum of its messages' scores; the ``branches`` best leaves of each tree are kept,
    all with None; ties go to the lower leaf. A parent that is null, missing, or not below the
    node's own number is no link: that row starts a path, so replies cannot form a circle.

    Two runs of self-joins. Upwards, each doubles the reach of a link until all have met their
    root, carrying the score and the number of steps. Downwards, the links of each length, longest
    first, double the part of a path that is known. A path of n messages takes 2 log2(n) joins, in
    which only messages with links left take part, and no row ever holds more than one link, so a
    chain of any length is spread over all tasks.
    """
    spark = messages.sparkSession
    nodes = messages.select(
        "tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    )
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    linked = nodes.join(known, ["tree", "parent"], "left")
    is_link = F.col("_known") & (F.col("parent") < F.col("node"))
    links = written(
        linked.select(
            "tree", "node", F.when(is_link, F.col("parent")).alias("far"), "score",
            F.when(is_link, F.lit(1)).otherwise(F.lit(0)).cast("long").alias("steps"),
        ),
        "links",
    )
    settled, moving = links.filter(F.col("far").isNull()), links.filter(F.col("far").isNotNull())
    levels = []
    while not moving.isEmpty():
        levels.append(moving)
        beyond = settled.unionByName(moving).select(
            "tree", F.col("node").alias("far"), F.col("far").alias("_far"),
            F.col("score").alias("_score"), F.col("steps").alias("_steps"),
        )
        links = written(
            moving.join(beyond, ["tree", "far"]).select(
                "tree", "node", F.col("_far").alias("far"),
                (F.col("score") + F.col("_score")).alias("score"),
                (F.col("steps") + F.col("_steps")).alias("steps"),
            ),
            "links",
        )
        settled = settled.unionByName(links.filter(F.col("far").isNull()))
        moving = links.filter(F.col("far").isNotNull())
    leaves = settled
    if levels:
        parents = levels[0].select("tree", F.col("far").alias("node"))
        leaves = settled.join(parents, ["tree", "node"], "left_anti")
    if branches is not None:
        best = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
        leaves = leaves.withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= branches)
    path = leaves.select("tree", F.col("node").alias("leaf"), "node", F.col("steps").alias("step"))
    for k in reversed(range(len(levels))):
        jump = levels[k].select("tree", "node", "far")
        here = F.struct("node", "step")
        there = F.struct(F.col("far").alias("node"), (F.col("step") - (1 << k)).alias("step"))
        both = F.when(F.col("far").isNull(), F.array(here)).otherwise(F.array(here, there))
        path = path.join(jump, ["tree", "node"], "left").select("tree", "leaf", F.explode(both).alias("_at"))
        path = path.select("tree", "leaf", "_at.node", "_at.step")
    return path


def format_paths(path: DataFrame, messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One conversation per path: ``tree``, ``leaf``, ``formatted`` and ``loss_spans``.

    Each turn reads ``<|im_start|>role newline text <|im_end|> newline``. ``loss_spans`` lists the
    (start, length) in code points, from 0, of the texts to learn, those of role ``learn``.
    A path is one output row, so its turns meet in one task; nothing else of its tree does.
    """
    body = messages.select(
        "tree", "node",
        escape_role(F.coalesce("role", F.lit(""))).alias("_role"),
        escape(F.coalesce("text", F.lit(""))).alias("_text"),
        (F.col("role") == learn).alias("_learn"),
    )
    opening = F.length("_role") + len(START) + 1
    whole = opening + F.length("_text") + len(END) + 1
    before = Window.partitionBy("tree", "leaf").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    turns = path.join(body, ["tree", "node"]).select(
        "tree", "leaf", "step",
        F.concat(F.lit(START), "_role", F.lit("\n"), "_text", F.lit(END + "\n")).alias("turn"),
        F.when(
            F.col("_learn"),
            F.struct(
                (F.coalesce(F.sum(whole).over(before), F.lit(0)) + opening).alias("start"),
                F.length("_text").cast("long").alias("length"),
            ),
        ).alias("span"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("step", "turn", "span")))
    return turns.groupBy("tree", "leaf").agg(ordered.alias("_turns")).select(
        "tree", "leaf",
        F.array_join(F.col("_turns.turn"), "").alias("formatted"),
        F.array_compact(F.col("_turns.span")).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text), texts unescaped."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda part: part != "")

    def turn(part: Column) -> Column:
        header = F.substring_index(part, "\n", 1)
        text = part.substr(F.length(header) + 2, F.length(part))
        return F.struct(
            unescape_role(header.substr(F.lit(len(START) + 1), F.length(header))).alias("role"),
            unescape(text).alias("text"),
        )

    return F.transform(parts, turn)


def turn_tree(conversations: DataFrame) -> DataFrame:
    """Messages of plain conversations: each turn replies to the one before it.

    Order: turn, role, text, nulls first, so turns with one number stand in a defined order and
    repeated rows follow each other. ``score`` is the text's length. A null conv_id is one
    conversation of its own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(order))
    return numbered.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null")).alias("tree"),
        "conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        F.length("text").alias("score"), "role", "text",
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Format plain conversations (conv_id, turn, role, text) as paths of their reply trees.

    Gives conv_id, ``formatted``, ``loss_spans``. Null role or text counts as empty; other columns
    are not read; no rows in, no rows out.
    """
    messages = written(turn_tree(conversations), "messages")
    made = format_paths(reply_paths(messages), messages)
    own = F.when(F.col("tree") != "null", F.expr("substring(tree, 2)"))
    kind = conversations.schema["conv_id"].dataType
    return made.select(own.cast(kind).alias("conv_id"), "formatted", "loss_spans")


def learnt_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, cut out of a formatted conversation and unescaped."""
    return F.transform(
        spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Counts and hashes of conversations as they are read back: turns parsed from ``formatted``, learnt
    text cut from it by ``loss_spans``."""
    turns = formatted.withColumn("_turns", parse(F.col("formatted")))
    said = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return turns.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.array_join(learnt_texts(F.col("formatted"), F.col("loss_spans")), "").alias("_learnt"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    ).select(
        "conv_id", "n_turns", "turns_sha256",
        F.length("_learnt").cast("long").alias("loss_chars"),
        F.sha2("_learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(rows.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return digest(format_conversations(rows.unionByName(probe)))


SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
marked AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\|im_start\|>|\|im_end\|>|/?SYS>>)',
    '\1\\\2\3', 'g') AS escaped,
    replace(replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C'), '[', '%5B') AS head FROM said),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt,
    sum(length(escaped) + length(head) + {len(START) + len(END) + 2})::BIGINT AS formatted_chars
  FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learnt)::BIGINT AS loss_chars,
  sha256(learnt) AS loss_sha256, formatted_chars FROM joined
"""
