"""Chat formatting from reply trees, with DataFrame functions only.

Messages are nodes with a parent. Iterative self-joins double each node's jump to its ancestors, so that a path of n
messages takes log2(n) joins; the first pass gives each node's depth and the score of its path from the root. Leaves
are ranked by that score within their tree, and the chosen ones walk back over the kept jumps, longest first, which
enumerates their root-to-leaf paths. Each path becomes one conversation in a template:

    <turn ROLE>\\nTEXT\\n</turn>\\n

Control strings inside a text, ``<turn`` and ``</turn`` with any number of backslashes after the ``<``, get one
backslash more, and lose it on the way back; in a role ``\\``, ``>`` and line ends are escaped. The loss mask is the list of spans of
the assistant's texts, in code points of the formatted string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

END = "\n</turn>\n"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*/?turn)", r"<\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*/?turn)", "<$1")


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescaped_role(role: Column) -> Column:
    """Backslash pairs are set aside as U+0000 pairs of their own, so that ``\\\\n`` isn't read as a line end."""
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\g"), F.lit(">")), F.lit("\\n"), F.lit("\n"))), "\\")


def from_turns(rows: DataFrame) -> DataFrame:
    """Nodes of trees from rows (conv_id, turn, role, text): each turn answers the one before. Ties in turn are ordered
    by role and text; repeated rows are turns of their own; null turns come first; a null conv_id is a conversation."""
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", "turn", "role", "text").withColumn("node", F.row_number().over(by).cast("long")).select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score")
    )


def paths(nodes: DataFrame, branches: int = 1, rounds: int = 40) -> DataFrame:
    """(tree, rank, depth, node) of the nodes on each tree's ``branches`` best root-to-leaf paths.

    Nodes (tree, node, parent, score): node ids are unique in their tree. A node whose parent is null or missing is a
    root; nodes on or below a cycle belong to no path. A path's score is its nodes' mean (null scores count as 0);
    ties go to the smaller leaf. Rank 1 is the best path of a tree."""
    base = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    have = base.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    linked = base.join(have, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left").select(
        "tree", "node", F.col("n").alias("up"), F.lit(1).cast("long").alias("steps"), "score"
    )
    # after k joins: 'up' is the ancestor 2^k steps above (null if there is none), 'steps' and 'score' sum what lies between
    jump = saved(linked, "jumps")
    jumps = [jump.filter("up is not null").select("tree", "node", "up")]
    for _ in range(rounds):
        open_ = jump.filter("up is not null")
        if open_.isEmpty():
            break
        far = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("score").alias("score2"))
        step = open_.join(far, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("score") + F.col("score2")).alias("score")
        )
        # roots stay in reach of later joins: what has no ancestor left keeps its sums
        step = saved(step.unionByName(jump.filter("up is null")), "jumps")
        jump = step
        jumps.append(jump.filter("up is not null").select("tree", "node", "up"))
    finished = jump.filter("up is null")
    inner = base.filter("parent is not null").select(F.col("tree").alias("t"), F.col("parent").alias("n")).distinct()
    leaves = finished.join(inner, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc(F.col("score") / F.col("steps")), "node"))
    found = leaves.withColumn("rank", rank).filter(F.col("rank") <= branches).select("tree", "rank", "node", F.col("steps").alias("depth"))
    for k, table in reversed([*enumerate(jumps)]):  # each row stays and brings its ancestor: one join a level
        up = table.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        both = F.inline(F.array(F.struct("node", "depth"), F.struct(F.col("up").alias("node"), (F.col("depth") - 2**k).alias("depth"))))
        found = found.join(up, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left").select("tree", "rank", both).filter("node is not null")
    return found


def formatted(nodes: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, rank, n_turns, formatted, loss_spans): each chosen path as one conversation.

    ``nodes`` as for ``paths``, with role and text; null roles and texts are empty. Other columns are not read. An empty
    table gives no rows. A conversation's turns meet in one row, which is what the format asks for."""
    nodes = saved(nodes.select("tree", "node", "parent", "role", "text", "score"), "nodes")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.concat(F.lit("<turn "), escaped_role(role), F.lit(">\n")).alias("head"), escaped(text).alias("body"), (role == loss_role).alias("learn"))
    turns = paths(nodes, branches).join(words, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
    listed = turns.groupBy("tree", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "head", "body", "learn"))).alias("turns"))
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(END)
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + size(x)).alias("at"),
            F.when(x["learn"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(x["head"])).alias("start"), (a["at"] + F.length(x["head"]) + F.length(x["body"])).alias("end")))))
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )
    return listed.select(
        "tree",
        "rank",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        spans["spans"].alias("loss_spans"),
    )


def parsed(rows: DataFrame) -> DataFrame:
    """``rows`` of ``formatted`` read back: ``turns`` array of (role, text) and ``loss_text``, what lies under the mask."""
    parts = F.split(F.col("formatted"), END, -1)
    turn = lambda p: F.struct(
        unescaped_role(F.regexp_extract(p, r"^<turn ([^>]*)>", 1)).alias("role"), unescaped(F.regexp_replace(p, r"^<turn [^>]*>\n", "")).alias("text")
    )
    under = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return rows.withColumns({"turns": F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), turn), "loss_text": F.array_join(under, "")})


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back."""
    got = parsed(formatted(from_turns(conversations)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return got.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
