"""Reply trees to conversations, with DataFrame functions alone.

Messages point to the message they answer.  Root-to-leaf paths come from iterative
self-joins: each round joins the table of ancestors 2**k steps up to itself, so a chain
of any length takes a logarithmic number of rounds, and scores add up on the way.
Branches of a tree are ranked by their mean score; each chosen path is walked back by
the same tables and formatted as one conversation.

Template: ``<turn ROLE>TEXT</turn>`` and a line feed for each turn.  Inside roles and
texts ``\\`` is written ``\\b``, ``<`` is ``\\l`` and ``>`` is ``\\g``, so no text can form
a mark, and reading back is exact.  The loss mask is a list of [start, end) spans of
code points, one for each assistant turn: its escaped text without marks.

Rules: null text or role counts as empty; a null tree is a tree of its own.  A message
whose parent is missing is a root.  Of rows that share tree and node one stays (the
least by role, text and parent).  Ties of branches go to the smaller leaf.  A cycle of
parents is an error.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

OPEN, ROLE_END, CLOSE = "<turn ", ">", "</turn>\n"
LOSS_ROLE = "assistant"


def escaped(x: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def unescaped(x: Column) -> Column:
    """Every backslash starts a code, and the one for itself is undone last."""
    for plain, code in (("<", "\\l"), (">", "\\g"), ("\\", "\\b")):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def ancestors(nodes: DataFrame) -> list[DataFrame]:
    """Tables (tree, node, up, total, depth), the k-th with the ancestor 2**k steps up, or
    null beyond the root; ``total`` and ``depth`` sum score and count of the nodes passed."""
    real = nodes.select(F.col("tree"), F.col("node").alias("parent"), F.lit(True).alias("there")).distinct()
    first = nodes.join(real, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth"))
    tables = [staged(first, "up")]
    # No path is longer than the number of nodes.
    for _ in range(nodes.count().bit_length() + 1):
        now = tables[-1]
        # Nodes that have reached their root take no part in further joins.
        active = now.where("up is not null")
        if active.isEmpty():
            return tables
        above = now.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("total").alias("more"), F.col("depth").alias("further"))
        step = active.join(above, ["tree", "up"]).select("tree", "node", F.col("next").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("further")).alias("depth"))
        tables.append(staged(step.union(now.where("up is null")), "up"))
    raise ValueError("parents form a cycle")


def formatted_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """tree, leaf, score, n_turns, formatted, loss_spans of the best ``branches`` of each tree.

    ``messages``: tree, node, parent, score, role, text.
    """
    rows = messages.groupBy("tree", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("parent").alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("m"))
    key = F.coalesce(F.concat(F.lit("="), F.col("tree").cast("string")), F.lit("-"))
    rows = staged(rows.select(key.alias("tree"), F.col("tree").alias("name"), "node", "m.*"), "messages")

    tables = ancestors(rows.select("tree", "node", "parent", "score"))
    inner = tables[0].where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = tables[-1].join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("depth")).alias("score"), "depth")
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    chosen = leaves.withColumn("place", F.row_number().over(best)).where(F.col("place") <= branches).drop("place")

    # Back from each chosen leaf: every table doubles the part of the path that is known.
    path = chosen.select("tree", "leaf", "score", F.col("leaf").alias("node"), F.col("depth").alias("at"))
    for k in range(len(tables) - 1, -1, -1):
        # Read twice below, so it is written first: plans stay small however deep trees are.
        path = staged(path, "path")
        jump = tables[k].where("up is not null").select("tree", "node", "up")
        path = path.union(path.join(jump, ["tree", "node"]).select("tree", "leaf", "score", F.col("up").alias("node"), F.col("at") - 2**k))
    turns = path.join(rows.select("tree", "name", "node", "role", "text"), ["tree", "node"])

    turns = turns.withColumns({"role_out": escaped(F.col("role")), "text_out": escaped(F.col("text"))})
    turns = turns.withColumn("turn_out", F.concat(F.lit(OPEN), "role_out", F.lit(ROLE_END), "text_out", F.lit(CLOSE)))
    size = F.length("turn_out").cast("long")
    so_far = Window.partitionBy("tree", "leaf").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(size).over(so_far) - size + len(OPEN) + len(ROLE_END) + F.length("role_out")
    turns = turns.withColumn("start", start)
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(F.col("start").alias("start"), (F.col("start") + F.length("text_out")).alias("end")))
    grouped = turns.groupBy("tree", "leaf").agg(F.first("name").alias("name"), F.first("score").alias("score"), F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(F.struct("at", "turn_out"))).alias("all_turns"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return grouped.select(F.col("name").alias("tree"), "leaf", "score", "n_turns", F.array_join(F.transform("all_turns", lambda t: t["turn_out"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``turns`` (role, text) and ``loss_texts``, from its text and mask alone."""
    raw = F.split("formatted", CLOSE, -1)
    marked = F.slice(raw, F.lit(1), F.size(raw) - 1)

    def turn(x: Column) -> Column:
        end = F.instr(x, ROLE_END)
        role = F.substring(x, F.lit(len(OPEN) + 1), end - (len(OPEN) + 1))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(x, end + 1, F.length(x))).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.withColumns({"turns": F.transform(marked, turn), "loss_texts": loss})


def linear_messages(conversations: DataFrame) -> DataFrame:
    """Messages of a table of conv_id, turn, role, text: each turn answers the one before.
    Ties of ``turn`` are ordered by role and text, null first."""
    own = conversations.select(F.col("conv_id").cast("long").alias("tree"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    return own.withColumn("node", place).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
