"""Chat formatting of reply trees.

Self-joins that double the distance to an ancestor give every message its depth and the sum
of scores above it in as many rounds as the longest branch has binary digits. Branches are
ranked by mean score, and only the chosen ones are walked up again, with the same doubled
pointers, and written as one conversation each.

The template marks turns with control strings. Inside texts, every ``<`` that bars follow
gets one bar more, so a text never holds a control string and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomatlas.llm.common import stored

START, END = "<|im_start|>", "<|im_end|>"
#: Written for a line end in a role; no escaped text holds it.
ROLE_LINE = "<|n|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\|+)", r"<$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\|(\|+)", r"<$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ROLE_LINE))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ROLE_LINE), F.lit("\n")))


def _messages(messages: DataFrame) -> DataFrame:
    """One row a message: roots have no ``_parent``; the smallest row of a repeated id stays."""
    key = F.struct(F.col("tree_id").isNull().alias("_none"), F.coalesce(F.col("tree_id").cast("string"), F.lit("")).alias("_id"))
    rows = messages.select(
        F.xxhash64(key).alias("_hash"),
        key.alias("_tree"),
        F.col("tree_id"),
        F.col("message_id").alias("_node"),
        F.struct(
            F.col("parent_id").alias("_parent"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
        ).alias("_row"),
    ).where("_node is not null")
    one = rows.groupBy("_tree", "_node").agg(F.min("tree_id").alias("tree_id"), F.min("_row").alias("_row"))
    return one.select("_tree", "_node", "tree_id", "_row.*")


def branches(messages: DataFrame, paths: int = 1) -> DataFrame:
    """The ``paths`` best root-to-leaf paths of each tree: a row for each message on them.

    ``messages``: ``tree_id, message_id, parent_id, role, text, score``. A message whose parent
    is absent, or is the message itself, starts a tree's branch. Ties in mean score go to the
    longer branch, then to the smaller leaf id. Messages above which replies run in a circle
    reach no root and are left out. Null roles and texts are empty, null scores 0, rows
    without an id are left out. Columns: ``tree_id, path_rank, leaf, depth, role, text``.
    """
    rows = _messages(messages)
    known = rows.select("_tree", F.col("_node").alias("_parent"), F.lit(True).alias("_known"))
    linked = rows.join(known, ["_tree", "_parent"], "left")
    real = F.col("_known") & (F.col("_parent") != F.col("_node"))
    nodes = stored(linked.withColumn("_parent", F.when(real, F.col("_parent"))).drop("_known"), "messages")
    step = stored(
        nodes.select(
            "_tree",
            "_node",
            F.col("_parent").alias("_up"),
            F.when(F.col("_parent").isNull(), 0).otherwise(1).alias("_depth"),
            F.col("score").alias("_sum"),
        ),
        "ancestors",
    )
    steps = [step]
    largest = nodes.groupBy("_tree").count().agg(F.max("count")).first()[0] or 1
    while step.where("_up is not null").limit(1).count() and 2 ** len(steps) < 2 * largest:
        above = step.select("_tree", F.col("_node").alias("_up"), F.col("_up").alias("_next"), F.col("_depth").alias("_more"), F.col("_sum").alias("_add"))
        pending = step.where("_up is not null").join(above, ["_tree", "_up"]).select(
            "_tree",
            "_node",
            F.col("_next").alias("_up"),
            (F.col("_depth") + F.col("_more")).alias("_depth"),
            (F.col("_sum") + F.col("_add")).alias("_sum"),
        )
        step = stored(step.where("_up is null").unionByName(pending), "ancestors")
        steps.append(step)
    rooted = step.where("_up is null").select("_tree", "_node", "_depth", (F.col("_sum") / (F.col("_depth") + 1)).alias("_mean"))
    parents = nodes.where("_parent is not null").select("_tree", F.col("_parent").alias("_node")).distinct()
    best = Window.partitionBy("_tree").orderBy(F.desc("_mean"), F.desc("_depth"), "_node")
    chosen = (
        rooted.join(parents, ["_tree", "_node"], "left_anti")
        .withColumn("path_rank", F.row_number().over(best))
        .where(F.col("path_rank") <= paths)
        .select("_tree", "path_rank", F.col("_node").alias("leaf"), "_node")
    )
    for pointers in reversed(steps):
        up = pointers.where("_up is not null").select("_tree", "_node", "_up")
        chosen = chosen.join(up, ["_tree", "_node"], "left").select(
            "_tree", "path_rank", "leaf", F.explode(F.array_compact(F.array("_node", "_up"))).alias("_node")
        )
    on_path = nodes.select("_tree", "_node", "tree_id", "role", "text").join(rooted.select("_tree", "_node", "_depth"), ["_tree", "_node"])
    return chosen.join(on_path, ["_tree", "_node"]).select(
        "_tree", "tree_id", "path_rank", "leaf", F.col("_depth").alias("depth"), "role", "text"
    )


def format_trees(messages: DataFrame, paths: int = 1, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Each chosen path as one conversation: ``tree_id, path_rank, n_turns, formatted, segments``.

    ``segments`` are the pieces of ``formatted`` in order, each with ``loss``: true for the
    escaped texts of the roles in ``learn``, false for everything else.
    """
    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def turn(t: Column) -> Column:
        return F.array(
            piece(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")), F.lit(False)),
            piece(escape(t["text"]), t["role"].isin(*learn)),
            piece(F.lit(END + "\n"), F.lit(False)),
        )

    turns = F.sort_array(F.collect_list(F.struct("depth", "role", "text")))
    return (
        branches(messages, paths)
        .groupBy("_tree", "path_rank", "leaf")
        .agg(F.min("tree_id").alias("tree_id"), turns.alias("_turns"))
        .select("tree_id", "path_rank", F.size("_turns").cast("long").alias("n_turns"), F.flatten(F.transform("_turns", turn)).alias("segments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, roles and texts as they were."""
    pieces = F.split(formatted, rf"\Q{END}\E\n")

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.char_length(piece))
        role = F.substring_index(body, "\n", 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(body, F.char_length(role) + 2, F.char_length(body))).alias("text"))

    return F.transform(F.filter(pieces, lambda p: p != ""), turn)
