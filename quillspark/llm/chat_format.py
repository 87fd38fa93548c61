"""Chat formatting of reply trees with DataFrame functions only.

Self-joins by doubling give each message its ancestors 1, 2, 4, ... replies above; from each leaf, the
same tables in falling order enumerate every ancestor once, so a thread of n replies takes 2 log2(n)
joins on (tree, message) and as many rows as its paths have messages. Branches are ranked by the sum of
their messages' scores; each chosen path becomes one conversation.

A turn is written as "### role: text </turn>" and a line end. In texts and roles a backslash goes before
every backslash, # and <, and in roles before colons, so that no text can look like a mark of the
template; taking away one backslash of each pair gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
NO_ID = -(2**63)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame) -> DataFrame:
    """messages: (tree, node, parent) longs, (tree, node) unique. Returns (tree, leaf, node, above): each
    message on the way from each leaf to its root, and how far above the leaf it is.

    A parent that is null, absent or the message itself makes a root. Messages on a cycle, or below one,
    have no root and are on no path."""
    nodes = messages.select("tree", "node")
    known = nodes.select("tree", F.col("node").alias("parent"))
    jumps = [materialize(messages.where("parent is not null and parent <> node").select("tree", "node", "parent").join(known, ["tree", "parent"], "left_semi").select("tree", "node", "parent"), "replies")]
    leaves = nodes.join(jumps[0].select("tree", F.col("parent").alias("node")).distinct(), ["tree", "node"], "left_anti")
    largest = messages.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while len(jumps) <= largest.bit_length():
        low, high = jumps[-1], jumps[-1].select("tree", F.col("node").alias("parent"), F.col("parent").alias("above"))
        up = materialize(low.join(high, ["tree", "parent"]).select("tree", "node", F.col("above").alias("parent")), "jumps")
        if not up.take(1):
            break
        jumps.append(up)
    at = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    if len(jumps) > largest.bit_length():
        # More replies above than the tree has messages: below a cycle. Such leaves are left out.
        at = at.join(jumps[-1].select("tree", "node"), ["tree", "node"], "left_anti").select("tree", "leaf", "node", "above")
    for r in reversed(range(len(jumps))):
        here = F.struct("node", "above")
        further = F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("node"), (F.col("above") + (1 << r)).alias("above")))
        both = at.join(jumps[r], ["tree", "node"], "left").select("tree", "leaf", F.explode(F.array_compact(F.array(here, further))).alias("m"))
        at = both.select("tree", "leaf", "m.node", "m.above")
    out = materialize(at, "paths")
    for j in jumps:
        discard(j)
    return out


def format_threads(messages: DataFrame, tree: str = "tree_id", node: str = "node_id", parent: str = "parent_id", role: str = "role", text: str = "text", score: str | None = None, best: int | None = None, assistant: str = "assistant") -> DataFrame:
    """Each root-to-leaf path of each reply tree, or the `best` of a tree, as one formatted conversation.

    Returns one row per chosen path: tree_id, leaf_id, branch_rank (from 1, by falling sum of scores,
    ties to the smaller leaf), branch_score, formatted, n_turns, loss_spans (array of start and length in
    code points of each assistant text in `formatted`, in order). A null text or role counts as empty, a
    null score as 0. Rows with a null tree id form one tree; rows with a null message id are left out,
    and of rows that repeat a (tree, message) the first by parent, role and text counts. Other columns
    are ignored. An empty table gives an empty result.
    """
    m = messages.select(
        F.coalesce(F.col(tree).cast("long"), F.lit(NO_ID)).alias("tree"),
        F.col(node).cast("long").alias("node"),
        F.col(parent).cast("long").alias("parent"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(score).cast("double") if score else F.lit(1.0), F.lit(0.0)).alias("score"),
    ).where("node is not null")
    first = F.row_number().over(Window.partitionBy("tree", "node").orderBy("parent", "role", "text", "score"))
    m = materialize(m.withColumn("nth", first).where("nth = 1").drop("nth"), "messages")
    way = paths(m.select("tree", "node", "parent"))
    branches = way.join(m.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("branch_score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf"))
    branches = branches.withColumn("branch_rank", rank)
    if best is not None:
        branches = branches.where(F.col("branch_rank") <= best)

    head = F.concat(F.lit(OPEN), F.regexp_replace(escape(F.col("role")), ":", r"\\:"), F.lit(BETWEEN))
    turns = way.join(m.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree", "leaf", "above", (F.col("role") == assistant).alias("learned"), head.alias("head"), escape(F.col("text")).alias("body"))
    size = F.char_length("head") + F.char_length("body") + len(CLOSE)
    before = F.sum(size).over(Window.partitionBy("tree", "leaf").orderBy(F.desc("above"))) - size
    placed = turns.select("tree", "leaf", F.struct((-F.col("above")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("turn"), F.when(F.col("learned"), F.struct((before + F.char_length("head")).cast("long").alias("start"), F.char_length("body").cast("long").alias("length"))).alias("span")).alias("turn"))
    whole = placed.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    whole = whole.select("tree", "leaf", F.array_join("turns.turn", "").alias("formatted"), F.size("turns").cast("long").alias("n_turns"), F.array_compact("turns.span").alias("loss_spans"))
    out = whole.join(branches, ["tree", "leaf"])
    return out.select(F.when(F.col("tree") != NO_ID, F.col("tree")).alias("tree_id"), F.col("leaf").alias("leaf_id"), "branch_rank", "branch_score", "formatted", "n_turns", "loss_spans")


def read_back(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """Add `turns`, the roles and texts (array of role, text) that a formatted conversation holds."""
    raw = F.slice(F.split(column, CLOSE), 1, F.size(F.split(column, CLOSE)) - 1)
    role, body = r"(?s)^### ([^\\:]*+(?:\\.[^\\:]*+)*+): (.*)$", 2
    turn = F.transform(raw, lambda x: F.struct(unescape(F.regexp_extract(x, role, 1)).alias("role"), unescape(F.regexp_extract(x, role, body)).alias("text")))
    return formatted.withColumn("turns", turn)


def conversation_threads(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Linear conversations as reply trees: each row replies to the one before it, by turn (ties by role, then text)."""
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col(conv_id).cast("long").alias("tree_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("node_id", F.row_number().over(order).cast("long"))
    return rows.select("tree_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation holds, read back from it, as digests."""
    back = read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    back = back.select(F.col("tree_id").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), turns.alias("all"), learned.alias("learned"), "formatted")
    return back.select("conv_id", "n_turns", F.sha2("all", 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))
