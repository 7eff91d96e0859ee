"""Chat formatting over reply trees, in DataFrame functions.

Every message but a root answers another one. Iterative self-joins double the reach of each node's ancestor link, so
that the members of all root-to-leaf paths are listed in as many rounds as the depth has binary digits. Branches are
ranked by the mean score of their messages (ties: the smaller leaf), the best ones are chosen, and each is formatted as
one conversation with the spans that a loss counts.

Nulls: a text or role is empty, a score 0, a tree without id is a tree of its own. A message whose parent isn't there is a
root. Repeated rows of a conversation table are turns of their own, in order of turn (null first), role and text. An
empty table has no conversations. Other columns are ignored.

Template: ``<|role|>\\ntext</s>\\n`` per turn. Inside roles and texts, backslash and ``< > [ ]`` are written as backslash and one
of ``\\ l g b r``, so no control string can occur there and the text comes back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ESCAPES = [("\\", "\\\\"), ("<", "\\l"), (">", "\\g"), ("[", "\\b"), ("]", "\\r")]
OPEN, SHUT, END = "<|", "|>\n", "</s>\n"
#: Roles whose text the loss counts.
LEARNED = ("assistant",)


def escaped(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    def part(p: Column) -> Column:
        for plain, code in ESCAPES[1:]:
            p = F.replace(p, F.lit(code), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(c, r"\\\\", -1), part), "\\")


def reply_paths(nodes: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): the members of each root-to-leaf path; up is the distance from the leaf.

    nodes has tree, node and parent; (tree, node) is unique, parents come before their children in some order.
    """
    own = nodes.select("tree", "node", "parent")
    links = own.join(own.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi").select("tree", "node", F.col("parent").alias("up_node"))
    jump = cut(links)
    leaves = own.join(links.select("tree", F.col("up_node").alias("node")), ["tree", "node"], "left_anti")
    path = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    reach = 1
    while not jump.isEmpty():
        step = jump.withColumnRenamed("up_node", "next")
        path = path.unionAll(path.join(step, ["tree", "node"]).select("tree", "leaf", F.col("next").alias("node"), (F.col("up") + reach).alias("up")))
        jump = cut(jump.join(step.withColumnRenamed("node", "up_node").withColumnRenamed("next", "far"), ["tree", "up_node"]).select("tree", "node", F.col("far").alias("up_node")))
        path = cut(path)
        reach *= 2
    return path


def formatted(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """(tree, leaf, branch_rank, branch_score, formatted, loss) for the best branches of each tree, all if branches is None.

    nodes: tree, node, parent, role, text, score. loss: array of (start, end), code points in formatted.
    """
    path = reply_paths(nodes)
    members = path.join(nodes.drop("parent"), ["tree", "node"])
    turn = F.struct((-F.col("up")).alias("at"), escaped("role_").alias("role"), escaped("text_").alias("text"), F.col("role_").isin(*LEARNED).alias("learned"))
    members = members.withColumns({"role_": F.coalesce("role", F.lit("")), "text_": F.coalesce("text", F.lit(""))})
    if branches is not None:  # rank before the texts are brought together
        scores = members.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("branch_score"))
        ranked = scores.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")))
        members = members.join(ranked.where(F.col("branch_rank") <= branches), ["tree", "leaf"])
    else:
        members = members.withColumns({"branch_score": F.lit(None).cast("double"), "branch_rank": F.lit(None).cast("int")})
    told = members.groupBy("tree", "leaf", "branch_rank", "branch_score").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    shown = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(SHUT), t["text"], F.lit(END))
    spans = "array<struct<start:int,end:int>>"

    def mask(a: Column, t: Column) -> Column:
        start = a["at"] + F.char_length(t["role"]) + len(OPEN) + len(SHUT)
        end = start + F.char_length(t["text"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + len(END)).alias("at"), F.when(t["learned"], F.concat(a["out"], span)).otherwise(a["out"]).cast(spans).alias("out"))

    loss = F.aggregate("turns", F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out")), mask, lambda a: a["out"])
    return told.select("tree", "leaf", "branch_rank", "branch_score", F.array_join(F.transform("turns", shown), "").alias("formatted"), loss.alias("loss"))


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Reply trees of a table of turns: each turn answers the one before it."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))).cast("long")
    no_id = F.lit(-(1 << 63)).cast("long")
    return conversations.select(F.coalesce("conv_id", no_id).alias("tree"), n.alias("node"), (n - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def read_back(chats: DataFrame) -> DataFrame:
    """What the formatted conversations say: turns and learned text, parsed from the output alone."""
    parts = F.transform(F.filter(F.split("formatted", "</s>\n", -1), lambda p: p != ""), lambda p: F.struct(F.substring_index(p, SHUT, 1).alias("head"), p.alias("whole")))
    turns = F.transform(parts, lambda p: F.concat(unescaped(F.substring(p["head"], F.lit(len(OPEN) + 1), F.char_length(p["head"]))), F.lit("\n"), unescaped(F.substring(p["whole"], F.char_length(p["head"]) + len(SHUT) + 1, F.char_length(p["whole"]))), F.lit("\n")))
    learned = F.array_join(F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    no_id = F.lit(-(1 << 63)).cast("long")
    return chats.withColumns({"turns_": turns, "learned_": learned}).select(
        F.when(F.col("tree") != no_id, F.col("tree")).alias("conv_id"),
        F.size("turns_").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns_", ""), 256).alias("turns_sha256"),
        F.char_length("learned_").cast("long").alias("loss_chars"),
        F.sha2("learned_", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle() -> str:
    esc = "{}"
    for plain, code in ESCAPES:
        esc = f"replace({esc}, '{plain}', '{code}')"
    size = lambda c: f"length({esc.format(c)})"
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    fixed = len(OPEN) + len(SHUT) + len(END)
    return f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(role, '') AS r, text, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -1, v.turn, v.role, v.role, '</s>[INST] ok [/INST]', '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' {order}) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum({size('r')} + {size('t')} + {fixed}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""
