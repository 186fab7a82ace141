"""Chat formatting of reply trees.

Messages point at the message they answer. Ancestors are found by iterative self-joins whose reach doubles each round;
root-to-leaf paths are ranked by score, and each chosen path becomes one conversation in a template that marks turns.
Control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.llm.shared import discard, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates, without their first character.
CONTROLS = (
    r"s>", r"/s>", r"INST\]", r"/INST\]", r"<SYS>>", r"</SYS>>", r"unk>", r"pad>", r"bos>", r"eos>", r"start_of_turn>", r"end_of_turn>",
    r"\|[A-Za-z0-9_]+\|>",
)
#: Put between a control string's first character and the rest; one more for each time that a text is escaped.
MARK = "\u2060"
_REST = "(?:" + "|".join(CONTROLS) + ")"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])({MARK}*)(?={_REST})", f"$1{MARK}$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[]){MARK}({MARK}*)(?={_REST})", "$1$2")


def _role(role: Column) -> Column:
    """A role as it stands in the template: percent-coded, so that no role breaks a line or a mark."""
    return F.url_encode(F.coalesce(role, F.lit("")))


def paths(messages: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """(tree, leaf, path_rank, depth, role, text) of the chosen root-to-leaf paths, one row a message.

    messages has tree, node, parent (null for a root), role, text and score. A path's score is the mean of its
    messages' scores (null counts as 0); paths of a tree rank by score, then by leaf; per_tree is how many are kept,
    None for all. Messages whose parent is missing are roots; of rows that repeat a node the least counts. Messages
    below a cycle have no root and so no path. Null trees are one tree; rows with a null node are left out. Other
    columns of messages are not carried; an empty table gives no rows.

    Jumps of doubling length sum up each path; only the chosen leaves are then expanded to their messages.
    """
    row = F.struct("parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    base = messages.where("node is not null").groupBy("tree", "node").agg(F.min(row).alias("m")).select("tree", "node", "m.parent", "m.role", "m.text", "m.score")
    base = written(base, "messages")
    limit = base.count()
    keys = base.select(F.col("tree").alias("pt"), F.col("node").alias("pn"))
    known = base.join(keys, F.expr("tree <=> pt and parent = pn"), "left")
    # (node, the message `up` so many answers above it or null, and of those passed the sum of scores and the number). Only
    # messages that have not come to their root climb on.
    state = written(known.select("tree", "node", F.col("pn").alias("up"), F.col("score").alias("total"), F.lit(1).cast("bigint").alias("length")), "jumps")
    jumps, ended, step = [state], [state.where("up is null")], 1
    climbing = state.where("up is not null")
    while step <= limit and not climbing.isEmpty():
        above = reduce(DataFrame.unionByName, ended, climbing).select(F.col("tree").alias("jt"), F.col("node").alias("jn"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("length").alias("longer"))
        climbed = climbing.join(above, F.expr("tree <=> jt and up = jn"))
        state = written(climbed.select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("length") + F.col("longer")).alias("length")), "jumps")
        jumps, ended, step = [*jumps, state], [*ended, state.where("up is null")], step * 2
        climbing = state.where("up is not null")
    has_child = jumps[0].where("up is not null").select(F.col("tree").alias("ct"), F.col("up").alias("cn")).distinct()
    # What still climbs after as many steps as there are messages does so for ever.
    leaves = reduce(DataFrame.unionByName, ended).join(has_child, F.expr("tree <=> ct and node = cn"), "left_anti")
    ranked = leaves.withColumn("path_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("length")), "node")))
    if per_tree is not None:
        ranked = ranked.where(F.col("path_rank") <= per_tree)
    # (leaf, node `above` it) for above < step; the jump of `step` gives those below 2 step.
    reached = written(ranked.select("tree", F.col("node").alias("leaf"), "path_rank", "length", "node", F.lit(0).cast("bigint").alias("above")), "paths")
    for k, jump in enumerate(jumps[:-1]):
        hop = jump.where("up is not null").select(F.col("tree").alias("jt"), F.col("node").alias("jn"), "up")
        further = reached.join(hop, F.expr("tree <=> jt and node = jn")).select("tree", "leaf", "path_rank", "length", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        passed, reached = reached, written(reached.unionByName(further), "paths")
        discard(passed)
    discard(*jumps)
    said = base.select(F.col("tree").alias("bt"), F.col("node").alias("bn"), "role", "text")
    return reached.join(said, F.expr("tree <=> bt and node = bn")).select("tree", "leaf", "path_rank", (F.col("length") - 1 - F.col("above")).cast("int").alias("depth"), "role", "text")


def chain(turns: DataFrame) -> DataFrame:
    """Messages of linear conversations (tree, turn, role, text): each answers the one before it, by turn, then role and text."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return turns.withColumn("node", F.row_number().over(order)).select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score")
    )


def format_paths(rows: DataFrame) -> DataFrame:
    """(tree, path_rank, formatted, loss_spans) of paths' rows: loss_spans are (start, length) in code points, from 1, of assistant texts.

    Turns follow by depth; null roles and texts are empty. Turns of one depth, which paths never make, follow by role and text,
    repeated ones all of them. One conversation is one row: its texts meet in one task. An empty table gives no rows.
    """
    turn = F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("tree", "path_rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), _role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == LOSS_ROLE).alias("loss")
        ),
    )
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out"))
    spans = F.aggregate(
        "pieces",
        start,
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(CLOSE) + 1).alias("at"),
            F.when(p["loss"], F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE + "\n"))), "")
    return whole.withColumn("pieces", pieces).select("tree", "path_rank", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    body = r"(?s)<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n"
    return F.transform(
        F.regexp_extract_all(formatted, F.lit(body), F.lit(0)),
        lambda t: F.struct(F.url_decode(F.regexp_extract(t, body, 1)).alias("role"), unescape(F.regexp_extract(t, body, 2)).alias("text")),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")
