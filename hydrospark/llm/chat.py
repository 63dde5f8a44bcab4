"""Chat formatting of reply trees.

Messages form trees by parent ids. Pointer doubling (a self-join per round, the
reach doubling each time) gives every message its depth and the score of its
root path; the best branches of a tree are chosen by these, and walked back
with the stored pointers of each round. A chain of n turns takes log2(n) joins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrospark.llm.common import cut_lineage

OPEN, CLOSE = "<|turn|>", "<|end|>"
# Strings with a meaning in this or other templates; none is left
# readable inside a text.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")
# A backslash goes behind the first character of every control string.
_BREAK = "|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROLS)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), _BREAK, "\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    """``escape``, and line breaks as a backslash and n, so that a role is one line."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(text: Column) -> Column:
    # Between doubled backslashes, a backslash before n is a line break and any other one a broken control string.
    parts = F.split(text, r"\\\\")
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\"), F.lit(""))),
                        "\\")


def branches(messages: DataFrame, best: int = 1, max_rounds: int = 40) -> DataFrame:
    """The ``best`` root-to-leaf paths per tree.

    ``messages``: tree, id, parent (null at a root), score (double, null counts
    as 0); of repeated (tree, id) rows the one with the smallest parent and score
    counts, and a parent that is not in the tree makes a root. Returns (tree, leaf, id, depth), one row per message of a chosen path.
    Paths are ranked by mean score, then depth, then leaf id, so ties have one
    result. Raises on a cycle.
    """
    nodes = messages.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    nodes = nodes.groupBy("tree", "id").agg(F.min(F.struct("parent", "score")).alias("m")).select("tree", "id", "m.*")
    known = nodes.select("tree", F.col("id").alias("up"))
    up = (nodes.withColumn("up", F.col("parent")).join(known.withColumn("_in", F.lit(True)), ["tree", "up"], "left")
          .select("tree", "id", F.when(F.col("_in"), F.col("up")).alias("up"), "score"))
    state = cut_lineage(up.select("tree", "id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("hops"),
                                  F.col("score").alias("sum")))
    jumps = []
    # sum covers the node and the hops - 1 nodes above it; at a root pointer the root itself is added at the end.
    for _ in range(max_rounds):
        if state.where("up is not null").isEmpty():
            break
        jumps.append(state.where("up is not null").select("tree", "id", "up"))
        far = state.select("tree", F.col("id").alias("up"), F.col("up").alias("far"), F.col("hops").alias("h2"),
                           F.col("sum").alias("s2"))
        state = cut_lineage(state.join(far, ["tree", "up"], "left").select(
            "tree", "id", F.col("far").alias("up"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"),
            (F.col("sum") + F.coalesce("s2", F.lit(0.0))).alias("sum")))
    else:
        raise ValueError("the parents form a cycle")
    inner = up.where("up is not null").select("tree", F.col("up").alias("id")).distinct()
    leaves = state.join(inner, ["tree", "id"], "left_anti")
    rank = Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / (F.col("hops") + 1)), F.desc("hops"), "id")
    walk = (leaves.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= best)
            .select("tree", F.col("id").alias("leaf"), "id"))
    walk = cut_lineage(walk)
    # Widest jumps first: after the round of width w all ancestors at multiples of w are in.
    for jump in reversed(jumps):
        walk = cut_lineage(walk.union(walk.join(jump, ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"))))
    return walk.join(state.select("tree", "id", F.col("hops").alias("depth")), ["tree", "id"]).select(
        "tree", "leaf", "id", "depth")


def format_paths(turns: DataFrame, keys: list[str], trained_role: str = "assistant") -> DataFrame:
    """One conversation per ``keys`` from rows (keys, depth, role, text):
    ``formatted`` and ``loss_spans``, the code point ranges (start, length) of
    the texts that count for the loss. Null roles and texts are empty."""
    role = escape_role(F.col("role"))
    row = turns.select(*keys, F.struct(
        F.col("depth"), F.concat(F.lit(OPEN), role, F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"),
        F.coalesce(F.col("role") == trained_role, F.lit(False)).alias("loss")).alias("t"))
    got = row.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("ts"))
    formatted = F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n"))), "")
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("out"))

    def add(acc, t):
        start = acc["at"] + F.length(t["head"])
        span = F.struct(start.alias("start"), F.length(t["body"]).alias("length"))
        return F.struct((start + F.length(t["body"]) + len(CLOSE) + 1).alias("at"),
                        F.when(t["loss"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return got.select(*keys, formatted.alias("formatted"),
                      F.aggregate("ts", zero, add, lambda a: a["out"]).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    parts = F.split(formatted, re.escape(OPEN))
    parts = F.slice(parts, 2, F.size(parts))
    tail = len(CLOSE) + 1
    return F.transform(parts, lambda p: F.struct(
        unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - tail)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"] + 1, s["length"]))), "")


def format_conversations(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text") -> DataFrame:
    """Conversations given as rows by turn, as reply trees without branches:
    each turn replies to the one before. Returns (conv_id, formatted,
    loss_spans), one row per conversation.

    Turns with equal numbers (repeated rows too) all stay, ordered by role and
    text; a null turn comes first. Rows with a null conversation id form one
    conversation. Null texts and roles are empty; both are read back as they
    were, line breaks and control strings included. Other columns are ignored
    whatever their names. A conversation is one row of the result, so a very long
    one is put together in one task. An empty table gives an empty result.
    """
    rows = table.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                        F.col(f"`{role_col}`").cast("string").alias("role"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    # A tree key that is never null keeps the joins plain equi-joins.
    rows = cut_lineage(rows.withColumn("id", F.row_number().over(order))
                       .withColumn("tree", F.to_json(F.struct("conv")))
                       .withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)))
    chosen = branches(rows.select("tree", "id", "parent", F.lit(0.0).alias("score")))
    turns = chosen.join(rows.select("tree", "id", "conv", "role", "text"), ["tree", "id"])
    done = format_paths(turns, ["tree", "leaf", "conv"])
    return done.select(F.col("conv").alias(conv_col), "formatted", "loss_spans")
