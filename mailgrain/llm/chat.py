"""Reply trees to training conversations: paths from root to leaf, ranked, formatted with a loss mask.

1. Iterative self-joins double the distance that every message looks up its tree, adding up scores on the way:
   after log2(depth) rounds each knows its depth and the score of its path.
2. The leaves of a conversation are ranked by the mean score of their paths, and the best are chosen.
3. The same joins, the longest distance first, list the messages of every chosen path; each is met once, as a
   distance is one sum of powers of two.
4. A path becomes one text. Markers show where turns begin and end; backslash, ``[``, ``]`` and ``<`` in a
   message are escaped, so no message can hold a marker and reading back gives every text as it was.

Only narrow rows (two ids and a score) go through the joins; texts are fetched once, for the chosen paths.

Defined results: a null role or text is empty; a null conversation id is a conversation of its own; rows of one turn are
ordered by role and text, repeated rows are turns of their own; a message whose parent is missing is a root; messages on
a cycle have no root and are on no path; an empty table has no conversations; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailgrain.functions.text import let
from mailgrain.llm.tables import stored

#: Fixed values of the template: role, opening and closing marker.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[ANS]", "</s>")}
OTHER, OTHER_END = "[ROLE:{}]", "[/ROLE]"
ESCAPES = {"\\": "\\e", "[": "\\o", "]": "\\c", "<": "\\l"}
#: No escaped text holds these, so a turn is what stands between an opening and a closing marker.
TURN = r"\[([A-Z]+(?::[^\]]*)?)\]([^\[<]*)(?:\[/[A-Z]+\]|</s>)"
LONGEST = 62


def linear(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) as a tree: each message answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order)
    rows = conversations.select("conv_id", node.alias("node"), "role", "text")
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def _climbs(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Per round, ``id, up``: the message twice as far up as in the round before; and ``id, depth, total`` of
    every message that has a root."""
    parents = messages.select(F.col("conv_id").alias("c"), F.col("node").alias("parent_node"), F.col("id").alias("up"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("parent_node"))
    one = F.lit(1).cast("long").alias("depth")
    here = stored(
        messages.join(parents, same, "left").select("id", "up", one, F.coalesce("score", F.lit(0.0)).alias("total")), "climb"
    )
    rounds, rooted = [], []
    for _ in range(LONGEST):
        rooted.append(here.filter("up IS NULL").select("id", "depth", "total"))
        moving = here.filter("up IS NOT NULL")
        if not moving.limit(1).count():
            break
        rounds.append(moving.select("id", "up"))
        above = here.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("d"), F.col("total").alias("t"))
        # Those that reached a root stay known to the ones that are still on the way to them.
        settled = rooted[0] if len(rooted) == 1 else _union(rooted)
        known = above.filter("next IS NOT NULL").unionByName(
            settled.select(F.col("id").alias("up"), F.lit(None).cast("long").alias("next"), F.col("depth").alias("d"), F.col("total").alias("t"))
        )
        step = moving.join(known, "up").select(
            "id", F.col("next").alias("up"), (F.col("depth") + F.col("d")).alias("depth"), (F.col("total") + F.col("t")).alias("total")
        )
        here = stored(step, "climb")
    return rounds, _union(rooted)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``conv_id, branch, depth, role, text`` of the best paths of every tree of ``messages``
    (conv_id, node, parent, role, text, score); branch 1 is the best."""
    messages = stored(messages.withColumn("id", F.monotonically_increasing_id()), "messages")
    rounds, depths = _climbs(messages.select("id", "conv_id", "node", "parent", "score"))
    depths = stored(depths, "depths")
    inner = rounds[0].select(F.col("up").alias("id")).distinct() if rounds else None
    leaves = depths if inner is None else depths.join(inner, "id", "left_anti")
    best = Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("depth")), "node", "id")
    ranked = leaves.join(messages.select("id", "conv_id", "node"), "id").withColumn("branch", F.row_number().over(best))
    paths = stored(ranked.filter(F.col("branch") <= branches).select(F.col("id").alias("leaf"), "id", "branch"), "path")
    for climb in reversed(rounds):
        higher = paths.join(climb, "id").select("leaf", F.col("up").alias("id"), "branch")
        paths = stored(paths.unionByName(higher), "path")
    texts = messages.select("id", "conv_id", "role", "text")
    return paths.join(depths.select("id", "depth"), "id").join(texts, "id").select("leaf", "conv_id", "branch", "depth", "role", "text")


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Backslashes come back last, as every backslash in an escaped text begins a code."""
    for plain, code in reversed(ESCAPES.items()):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _opening(role: Column) -> Column:
    other = F.concat(F.lit("[ROLE:"), escaped(role), F.lit("]"))
    for name, (begin, _) in MARKS.items():
        other = F.when(role == name, begin).otherwise(other)
    return other


def _closing(role: Column) -> Column:
    other = F.lit(OTHER_END)
    for name, (_, end) in MARKS.items():
        other = F.when(role == name, end).otherwise(other)
    return other


def formatted(paths: DataFrame) -> DataFrame:
    """``conv_id, branch, formatted, loss_spans`` of chosen paths. Loss spans are (start, end) in code points, end
    exclusive, of the assistant texts in ``formatted``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        "depth", (role == "assistant").alias("loss"), _opening(role).alias("begin"), escaped(text).alias("body"), _closing(role).alias("end")
    )
    lists = paths.groupBy("leaf", "conv_id", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.transform("turns", lambda t: F.concat(t["begin"], t["body"], t["end"]))

    def measure(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["begin"])
        end = start + F.length(t["body"])
        span = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(t["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((end + F.length(t["end"])).alias("at"), spans.alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    spans = F.aggregate("turns", begin, measure, lambda s: s["spans"])
    return lists.select("conv_id", "branch", F.array_join(whole, "").alias("formatted"), spans.alias("loss_spans"))


def read_back(text: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    regex = F.lit(TURN)
    pairs = F.arrays_zip(F.regexp_extract_all(text, regex, 1).alias("mark"), F.regexp_extract_all(text, regex, 2).alias("body"))

    def role(mark: Column) -> Column:
        out = unescaped(F.regexp_replace(mark, "^ROLE:", ""))
        for name, (begin, _) in MARKS.items():
            out = F.when(mark == begin.strip("[]"), name).otherwise(out)
        return out

    return F.transform(pairs, lambda p: F.struct(role(p["mark"]).alias("role"), unescaped(p["body"]).alias("text")))


def loss_text(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    parts = F.transform(spans, lambda s: unescaped(F.substring(text, s["start"] + 1, s["end"] - s["start"])))
    return F.array_join(parts, "")


def turns_text(turns: Column) -> Column:
    return let(turns, lambda all_turns: F.array_join(F.transform(all_turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
