"""Chat formatting from reply trees, in DataFrame functions only.

Messages name the message that they reply to. Every path from a first message to one without replies is a branch; its score is the sum of
its messages' scores. The best branches of a tree are formatted, each as one conversation.

Paths are found by joining the messages with themselves: after ``k`` rounds a message knows its ancestor ``2^k`` steps up and the scores in
between, so a chain of any length takes a logarithmic number of rounds. The messages of the chosen branches are found by walking the same
steps from the largest to the smallest. Only numbers travel in these rounds; texts are fetched once, for chosen messages.

Template: ``<turn ROLE>TEXT</turn>`` and a line feed for each message. In texts ``\\`` becomes ``\\s`` and ``<`` becomes ``\\l``; in roles
``>`` becomes ``\\g`` as well. So ``<`` and ``>`` of a mark never come from a text, and :func:`unescape` gives back exactly what was there.
The loss mask lists the spans of the formatted text that hold texts of the assistant.

Defined results: a null role or text is empty, a null score is 0; a message that replies to itself, to a later one of a circle or to an
unknown message starts a tree (of a circle nothing is reached, it has no first message); of repeated rows of one message the smallest by
role and text stays; branches of equal score rank by the id of their last message; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litprops.llm.store import Scratch

OPEN, SHUT, END = "<turn ", ">", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def branch_messages(messages: DataFrame, scratch: Scratch, top: int | None = 1) -> DataFrame:
    """``tree_id, leaf, branch_rank, branch_score, depth, node_id`` for the messages of the ``top`` best branches of each tree."""
    nodes = messages.groupBy("tree_id", "node_id").agg(F.min("parent_id").alias("parent_id"), F.max(F.coalesce("score", F.lit(0.0))).alias("score"))
    known = nodes.select(F.col("tree_id").alias("t"), F.col("node_id").alias("p"))
    linked = nodes.join(known, (F.col("tree_id").eqNullSafe(F.col("t"))) & (F.col("parent_id") == F.col("p")) & (F.col("parent_id") != F.col("node_id")), "left")
    level = scratch.put(linked.select("tree_id", "node_id", F.col("p").alias("up"), F.lit(1).alias("steps"), "score"), "up-0")
    levels = [level]  # table k has the messages with a 2^k-th ancestor or, with a null ``up``, those that met their first message in round k
    ended = level.filter("up is null")
    total = level.count()
    while True:
        rest = level.filter("up is not null")
        open_, longest = rest.agg(F.count("*"), F.max("steps")).first()
        if not open_ or longest > total:
            break
        above = ended.unionByName(rest).select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("up").alias("up2"), F.col("steps").alias("steps2"), F.col("score").alias("score2"))
        level = rest.join(above, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n"))).select(
            "tree_id", "node_id", F.col("up2").alias("up"), (F.col("steps") + F.col("steps2")).alias("steps"), (F.col("score") + F.col("score2")).alias("score")
        )
        level = scratch.put(level, f"up-{len(levels)}")
        levels.append(level)
        ended = ended.unionByName(level.filter("up is null"))
    replied = levels[0].filter("up is not null").select(F.col("tree_id").alias("t"), F.col("up").alias("n")).distinct()
    leaves = ended.join(replied, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")), "left_anti")
    ranked = leaves.select("tree_id", F.col("node_id").alias("leaf"), "steps", F.col("score").alias("branch_score"))
    ranked = ranked.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("branch_score"), "leaf")))
    if top is not None:
        ranked = ranked.filter(F.col("branch_rank") <= top)
    ranked = scratch.put(ranked, "branches")
    found = ranked.select("tree_id", "leaf", F.col("leaf").alias("node_id"), F.col("steps").alias("depth"))
    for k in range(len(levels) - 1, -1, -1):
        jump = levels[k].filter("up is not null").select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "up")
        higher = found.join(jump, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n"))).select(
            "tree_id", "leaf", F.col("up").alias("node_id"), (F.col("depth") - (1 << k)).alias("depth")
        )
        found = scratch.put(found.unionByName(higher), f"walk-{k}")
    named = ranked.select(F.col("tree_id").alias("t"), F.col("leaf").alias("l"), "branch_rank", "branch_score")
    return found.join(named, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("l"))).select("tree_id", "leaf", "branch_rank", "branch_score", "depth", "node_id")


def format_conversations(messages: DataFrame, top: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """``tree_id, leaf, branch_rank, branch_score, n_turns, formatted, loss_spans``, from ``tree_id, node_id, parent_id, role, text,
    score``. ``loss_spans`` are ``start`` (from 1) and ``length`` in code points of ``formatted``."""
    scratch = Scratch(messages.sparkSession, "chat")
    empty = F.lit("")
    texts = messages.groupBy("tree_id", "node_id").agg(F.min(F.struct(F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))).alias("m"))
    chosen = branch_messages(messages, scratch, top)
    texts = texts.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "m.role", "m.text")
    told = chosen.join(texts, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")))
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(">"), F.lit("\\g")), F.lit(SHUT))
    body = escape(F.col("text"))
    turn = F.struct("depth", head.alias("head"), body.alias("body"), (F.col("role") == loss_role).alias("loss"))
    grouped = told.groupBy("tree_id", "leaf", "branch_rank", "branch_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, x):
        begin, size = acc["at"] + F.length(x["head"]), F.length(x["body"])
        span = F.struct(begin.cast("int").alias("start"), size.cast("int").alias("length"))
        spans = F.when(x["loss"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((begin + size + len(END)).cast("int").alias("at"), spans.alias("spans"))

    out = grouped.select(
        "tree_id", "leaf", "branch_rank", "branch_score", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"),
        F.aggregate("turns", start, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )
    out = scratch.put(out, "formatted")
    scratch.drop("branches", *[f"up-{i}" for i in range(64)], *[f"walk-{i}" for i in range(64)])
    return out


def parse(formatted: Column) -> Column:
    """``role, text`` of every turn, read back from the formatted text."""
    pieces = F.split(formatted, F.lit(END))
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    role = lambda x: unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), SHUT, 1))
    text = lambda x: unescape(F.substr(x, F.length(F.substring_index(x, SHUT, 1)) + 2))
    return F.transform(turns, lambda x: F.struct(role(x).alias("role"), text(x).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"], s["length"]))), "")


def linear(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages of conversations without branches: each row replies to the one before it by turn, role and text."""
    order = Window.partitionBy(conversation).orderBy(F.col(turn).asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    numbered = rows.select(F.col(conversation).alias("tree_id"), F.row_number().over(order).alias("node_id"), "role", "text")
    return numbered.select("tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))
