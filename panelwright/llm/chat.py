"""Reply trees to conversations, in DataFrame expressions only.

A tree is a table of nodes with parents. Self-joins that double their stride find each node's root, depth and path score in log2(depth) rounds; the
best leaf of each tree is ranked by score; its ancestors, found by the same doubled pointers, are the chosen path, formatted as one conversation.

Format of a turn: ``<|im_start|>role\\ntext<|im_end|>\\n``. In a text a backslash becomes two and ``<|`` becomes ``<\\|``, so no control string can
occur inside; in a role URL encoding does the same. Both are undone exactly by ``unescape`` and ``url_decode``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Left to right: a backslash gives what follows it."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def tree_key(tree: Column) -> Column:
    """Never null, so that it can be joined on."""
    return F.coalesce(tree.cast("string"), F.lit("\x00null"))


def linear_tree(conversations: DataFrame, texts: bool = True) -> DataFrame:
    """Nodes of plain conversations: each turn replies to the one before, nodes are numbered from 1. ``t, tree, node, parent, role, text, score``.

    Rows of a conversation go by turn; ties by role and text, nulls first. Null conv_ids are one conversation. Null text or role: empty.
    ``texts=False`` leaves out role and text, on which the numbers, parents and scores do not depend: narrow rows for the choice of paths.
    """
    own = conversations.select(tree_key(F.col("conv_id")).alias("t"), F.col("conv_id").alias("tree"), "turn", *(["role", "text"] if texts else []))
    inside = Window.partitionBy("t").orderBy("turn", *(["role", "text"] if texts else []))
    out = own.withColumn("node", F.row_number().over(inside).cast("long")).withColumn("score", F.lit(1.0)).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).drop("turn")
    return out.withColumn("role", F.coalesce(F.col("role").cast("string"), F.lit(""))).withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit(""))) if texts else out


def chosen_paths(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """``t, path, tree, node, depth`` (from 0 at the root) of the ``best`` paths of each tree (None: all), ``path`` numbered from 1.

    ``nodes``: ``tree, node, parent, score``; a null or absent parent makes a root. Leaves rank by the sum of scores from root
    to leaf, then the deeper, then the smaller node. Each round joins every node to the ancestor that it points at and doubles the stride.
    Parents that form a cycle have no root; their nodes are left out. Null trees are compared as equal. An empty table gives an empty one; other columns are not read.
    """
    base = nodes.select(tree_key(F.col("tree")).alias("t"), "tree", "node", "parent", F.coalesce(F.col("score"), F.lit(0.0)).alias("score"))
    known = base.select("t", F.col("node").alias("parent"), F.lit(True).alias("has"))
    base = stage(base.join(known.hint("merge"), ["t", "parent"], "left").withColumn("parent", F.when(F.col("has"), F.col("parent"))).drop("has"), "tree-nodes")
    step = base.select("t", "node", F.col("parent").alias("up"), F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth"), F.col("score").alias("total"))
    # total: the scores of the nodes from this one up to, not with, the one it points at; at a root nothing is left to add.
    levels, done = [step.select("t", "node", "up")], step.filter("up is null")
    size = max(1, base.count())
    while True:
        open_rows = step.filter("up is not null")
        if not open_rows.limit(1).count() or 1 << len(levels) > 2 * size:
            break
        above = step.unionByName(done) if len(levels) > 1 else step
        above = above.select("t", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"))
        # Nodes that have reached their root are done; only the others are joined and written, fewer each round.
        joined = open_rows.join(above.hint("merge"), ["t", "up"], "left")
        moved = joined.select("t", "node", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"))
        moved = stage(moved, "tree-step")
        done = done.unionByName(moved.filter("up is null"))
        step = moved.filter("up is not null")
        levels.append(step.select("t", "node", "up"))
    inner = base.filter("parent is not null").select("t", F.col("parent").alias("node")).distinct()
    leaves = done.join(inner.hint("merge"), ["t", "node"], "left_anti")
    if best == 1:
        chosen = leaves.groupBy("t").agg(F.max_by("node", F.struct("total", "depth", -F.col("node"))).alias("node")).withColumn("path", F.lit(1))
    else:
        rank = F.row_number().over(Window.partitionBy("t").orderBy(F.desc("total"), F.desc("depth"), "node"))
        chosen = leaves.withColumn("path", rank).filter(F.lit(True) if best is None else F.col("path") <= best)
    path = chosen.select("t", "path", "node")
    for level in reversed(levels):
        found = path.join(level.filter("up is not null").hint("merge"), ["t", "node"]).select("t", "path", F.col("up").alias("node"))
        path = stage(path.unionByName(found), "paths")
    path = path.distinct()
    depth = done.select("t", "node", "depth").join(base.select("t", "tree", "node").hint("merge"), ["t", "node"])
    return path.join(depth.hint("merge"), ["t", "node"]).select("t", "path", "tree", "node", "depth")


def format_paths(nodes: DataFrame, best: int | None = 1, skeleton: DataFrame | None = None) -> DataFrame:
    """One row per chosen path: ``conv_id, path, formatted, loss`` (array of [start, end) in code points of ``formatted``, the assistant's texts), ``n_turns``.

    ``nodes``: ``tree, node, parent, score, role, text``; the texts of nodes off the paths are not gathered. ``skeleton`` is for plain conversations:
    ``linear_tree(..., texts=False)`` of those whose ``linear_tree`` is ``nodes``. Their nodes are numbered from 1 and nearly all on the path, so each
    conversation is gathered by the one shuffle that also numbered it. Null role or text: empty. An empty table gives an empty one.
    """
    head = F.concat(F.lit(START), F.url_encode(F.coalesce(F.col("role"), F.lit(""))), F.lit("\n"))
    parts = [head.alias("head"), escape(F.coalesce(F.col("text"), F.lit(""))).alias("body"), F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss")]
    if skeleton is None:
        path = chosen_paths(nodes.select("tree", "node", "parent", "score"), best)
        turns = path.select(F.col("t").alias("__t"), F.col("node").alias("__node"), "path", "depth")
        own = nodes.select(tree_key(F.col("tree")).alias("__t"), F.col("node").alias("__node"), "tree", "role", "text")
        joined = own.join(turns.hint("merge"), ["__t", "__node"])
        grouped = joined.groupBy("__t", "path").agg(F.first("tree").alias("conv_id"), F.sort_array(F.collect_list(F.struct(F.col("depth").alias("d"), *parts))).alias("p"))
    else:
        path = chosen_paths(skeleton.select("tree", "node", "parent", "score"), best)
        order = path.groupBy("t", "path").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("order"))
        whole = nodes.groupBy("t").agg(F.first("tree").alias("conv_id"), F.sort_array(F.collect_list(F.struct(F.col("node").alias("d"), *parts))).alias("all"))
        grouped = whole.join(order.hint("merge"), "t").select("conv_id", "path", F.transform("order", lambda x: F.get("all", x["node"].cast("int") - 1)).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    # Spans: a running place over the turns; each carries the places of its own text.
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        stop = start + F.length(x["body"])
        span = F.array(F.struct(start.alias("start"), stop.alias("end")))
        return F.struct((stop + len(END)).alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return grouped.select("conv_id", "path", text.alias("formatted"), F.aggregate("p", first, add)["spans"].alias("loss"), F.size("p").cast("long").alias("n_turns"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> back from a formatted conversation."""
    turns = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda x: x != "")

    def turn(x: Column) -> Column:
        cut = F.instr(x, "\n") if isinstance(x, str) else F.locate("\n", x)
        body = F.substring(x, cut + 1, F.length(x) - cut - len(END))
        return F.struct(F.url_decode(F.substring(x, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(turns, turn)


def digests(formatted: DataFrame) -> DataFrame:
    """From ``conv_id, formatted, loss``: what the stored conversations hold, after undoing the template."""
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = formatted.withColumn("turns", F.explode(F.array(parse(F.col("formatted"))))).withColumn("learnt", F.explode(F.array(loss)))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def write_conversations(nodes: DataFrame, best: int | None = 1, skeleton: DataFrame | None = None) -> DataFrame:
    """``format_paths`` written to the shared folder and read back."""
    return stage(format_paths(nodes, best, skeleton), "conversations")
