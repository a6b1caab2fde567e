"""Reply trees to formatted conversations. DataFrame functions only.

Paths from leaves to roots come from iterative self-joins with doubled jumps: after k rounds every path reaches
2^k ancestors, so a thread of a thousand replies takes ten joins.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

#: Strings that the template or common chat templates give a meaning; in texts each is broken by a backslash after its first character.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
#: What follows the first character of one; no end of one begins another, so matches never overlap.
REST = "(?:" + "|".join(re.sub(r"([\[\]|])", r"\\\1", c[1:]) for c in CONTROL) + ")"
TURN, TEXT, END, OPEN, CLOSE = "<|turn|>", "\n<|text|>", "\n<|end|>", "<s>", "</s>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """One more backslash after the first character of each control string, broken by backslashes before or not; so none is left
    whole and it can be undone."""
    return F.regexp_replace(text, r"([<\[])(\\*" + REST + ")", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*" + REST + ")", "$1$2")


def best_paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, depth, node, role, text): the best root-to-leaf paths of each tree.

    nodes: tree, node, parent (null: root), role, text, score. A path's score is the mean of its nodes' scores (null: 0);
    ties go to the smaller leaf. A parent that is missing makes its child a root. Repeated (tree, node) rows: the smallest
    stays. Nodes of a cycle reach no root and give no path.
    """
    one = F.min(F.struct("parent", "role", "text", "score")).alias("v")
    nodes = nodes.where(F.col("tree").isNotNull() & F.col("node").isNotNull()).groupBy("tree", "node").agg(one).select("tree", "node", "v.*")
    nodes = stage(nodes, "chat-nodes")
    known = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("_known"))
    jump = nodes.select("tree", "node", "parent").join(known, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("up"))
    leaves = nodes.select("tree", "node").join(jump.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    paths = stage(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("dist")), "chat-paths")
    jump = stage(jump, "chat-jump")
    roots = nodes.select("tree", "node").join(jump, ["tree", "node"], "left_anti").withColumn("_root", F.lit(True))
    # after k rounds a node still jumps if it lies 2^k deep or more, or leads into a cycle. Whoever lies deeper has an ancestor
    # that lies just so deep, so once a round ends no jump, only cycles are left: rounds grow with the deepest tree's logarithm
    step, before, left = 1, -1, jump.count()
    while left not in (0, before):
        further = paths.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("dist") + step).alias("dist"))
        paths = stage(paths.unionByName(further), "chat-paths")
        onward = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("far"))
        jump = stage(jump.join(onward, ["tree", "up"]).select("tree", "node", F.col("far").alias("up")), "chat-jump")
        step, before, left = 2 * step, left, jump.count()
    scored = paths.join(nodes.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("_score")), ["tree", "node"]).join(roots, ["tree", "node"], "left")
    whole = scored.groupBy("tree", "leaf").agg(F.avg("_score").alias("_score"), F.max("_root").alias("_root")).where("_root")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("_score").desc(), "leaf"))
    chosen = whole.withColumn("rank", rank).where(F.col("rank") <= top).select("tree", "leaf", "rank")
    return paths.join(chosen, ["tree", "leaf"]).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree", "leaf", "rank", "dist", "node", "role", "text")


def format_paths(paths: DataFrame) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): one string a path; loss: code-point spans of the assistant's texts in it."""
    w = Window.partitionBy("tree", "leaf").orderBy(F.col("dist").desc())
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = paths.withColumns({"_head": F.concat(F.lit(TURN), escape(role), F.lit(TEXT)), "_body": escape(text)})
    rows = rows.withColumn("_piece", F.concat("_head", "_body", F.lit(END)))
    before = F.sum(F.length("_piece")).over(w) - F.length("_piece")
    start = (before + F.length("_head") + len(OPEN)).cast("bigint")
    span = F.when(role == LOSS_ROLE, F.struct(start.alias("start"), F.length("_body").cast("bigint").alias("length")))
    rows = rows.select("tree", "leaf", "rank", "dist", "_piece", span.alias("_span"))
    turns = rows.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("dist")).alias("at"), "_piece", "_span"))).alias("_turns"))
    formatted = F.concat(F.lit(OPEN), F.array_join(F.col("_turns._piece"), ""), F.lit(CLOSE))
    return turns.select("tree", "leaf", "rank", formatted.alias("formatted"), F.array_compact(F.col("_turns._span")).alias("loss"))


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read from a formatted conversation."""
    inside = F.substring(formatted, F.lit(len(OPEN) + 1), F.length(formatted) - len(OPEN) - len(CLOSE))
    parts = F.filter(F.split(inside, r"<\|turn\|>"), lambda _, i: i > 0)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, TEXT, 1)
        at = F.length(role) + len(TEXT)
        text = F.substring(part, at + 1, F.length(part) - at - len(END))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """A linear conversation as a tree with one branch: each turn answers the one before it; equal turns follow each other."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(w).cast("bigint"))
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def format_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """op8: the conversations and the probe -7, formatted and read back."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_paths(best_paths(conversation_nodes(rows)))
    turns = parse_turns(F.col("formatted"))
    out = out.select(F.col("tree").alias("conv_id"), "formatted", turns.alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("bigint").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
