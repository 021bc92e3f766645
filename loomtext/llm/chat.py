"""Chat formatting of reply trees.

Messages with a parent form trees.  Iterative self-joins enumerate the paths from roots to leaves by doubling: in
round r a message knows its ancestor 2^r replies up, and what the messages in between score, so that a thread of
d messages takes log d rounds.  A tree's branches are ranked by score (the sum of their messages' scores), ties
by the path; the rounds' tables, joined again, list the messages of the branches that can be among the ``best``,
which are written out as one conversation each.  Texts join last.  Every round is a written table.

Cases: a message whose parent is missing or null is a root; messages that are their own ancestors have no root and
aren't formatted; equal rows are one message; several messages of one (tree, id) are one node, of which the
smallest (parent, role, text) counts; null ids of tree or message drop the row; a null text is empty, a null role is
"unknown", a null score is 0; threads and texts of any length are written out whole (a branch is one string, so of 2 GB at most); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import Scratch

#: Branches of a tree that are formatted.
BEST = 3


def ancestors(messages: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """((tree, id, depth, total) of every message under a root, [(tree, id, up): its 2^r-th ancestor, for each round r]).

    ``messages``: (tree, id, parent, score), unique by (tree, id).  ``total`` sums the scores from the root on.
    """
    real = messages.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there"))
    state = scratch.table(messages.join(real, ["tree", "parent"], "left").select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.col("score").alias("total"), F.lit(1).cast("long").alias("depth")), "state")
    rounds, left = [], state.filter("up IS NOT NULL").count()
    while left:
        rounds.append(state.filter("up IS NOT NULL").select("tree", "id", "up"))
        over = state.select("tree", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("total").alias("total2"), F.col("depth").alias("depth2"))
        state = scratch.table(state.join(over, ["tree", "up"], "left").select("tree", "id", F.col("up2").alias("up"), (F.col("total") + F.coalesce("total2", F.lit(0))).alias("total"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")), "state")
        now = state.filter("up IS NOT NULL").count()
        if now == left:  # only loops are left: each round ends some path if there is one
            break
        left = now
    return state.filter("up IS NULL").select("tree", "id", "depth", "total"), rounds


def paths(messages: DataFrame, scratch: Scratch, best: int | None) -> DataFrame:
    """(tree, leaf, score, path, branch_rank) of each tree's ``best`` root-to-leaf paths (None: of all)."""
    known, rounds = ancestors(messages, scratch)
    known = scratch.table(known, "known")
    leaves = known.join(messages.select("tree", F.col("parent").alias("id")), ["tree", "id"], "left_anti")
    if best:  # all that fewer than ``best`` beat by score alone; ties are settled by the paths
        leaves = leaves.withColumn("r", F.rank().over(Window.partitionBy("tree").orderBy(F.desc("total")))).filter(F.col("r") <= best)
    members = scratch.table(leaves.select("tree", F.col("id").alias("leaf"), "id"), "members")
    for up in rounds:
        higher = members.join(up, ["tree", "id"]).select("tree", "leaf", F.col("up").alias("id"))
        members = scratch.table(members.unionByName(higher), "members")
    lists = members.join(known.select("tree", "id", "depth"), ["tree", "id"]).groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "id")))["id"].alias("path"))
    scored = lists.join(leaves.select("tree", F.col("id").alias("leaf"), F.col("total").alias("score")), ["tree", "leaf"])
    ranked = scored.withColumn("branch_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "path")))
    return ranked.filter(F.col("branch_rank") <= best) if best else ranked


def format_trees(messages: DataFrame, best: int | None = BEST) -> DataFrame:
    """(tree, branch_rank, leaf, n_messages, score, conversation) of each tree's ``best`` branches (None: of all).

    ``messages``: (tree long, id long, parent long, role string, text string, score long).
    """
    scratch = Scratch(messages.sparkSession, "chat")
    one = F.row_number().over(Window.partitionBy("tree", "id").orderBy("parent", "role", "text", "score"))
    clean = messages.filter("tree IS NOT NULL AND id IS NOT NULL").select("tree", "id", "parent", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0)).cast("long").alias("score"))
    nodes = scratch.table(clean.withColumn("nth", one).filter("nth = 1").drop("nth"), "nodes")
    ranked = paths(nodes.select("tree", "id", "parent", "score"), scratch, best)
    # Messages and the places they have in branches meet in one shuffle by tree, in which the branches are put together, too
    said = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("text"), F.lit("<|im_end|>\n"))
    place = F.struct("branch_rank", "leaf", "score", F.col("pos").cast("int").alias("pos"))
    chosen = ranked.select("tree", "branch_rank", "score", "leaf", F.posexplode("path").alias("pos", "id")).select("tree", "id", place.alias("at"))
    both = nodes.select("tree", "id", said.alias("said")).unionByName(chosen, allowMissingColumns=True).repartition("tree")
    met = both.groupBy("tree", "id").agg(F.first("said", ignorenulls=True).alias("said"), F.collect_list("at").alias("at"))
    lines = met.select("tree", "said", F.explode("at").alias("at")).select("tree", "said", "at.*")
    whole = lines.groupBy("tree", "branch_rank", "leaf", "score").agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("m"))
    return whole.select("tree", "branch_rank", "leaf", F.size("m").alias("n_messages"), "score", F.array_join(F.col("m.said"), "").alias("conversation"))


def from_conversations(conversations: DataFrame) -> DataFrame:
    """The ``conversations`` table as reply trees.

    A message answers the last earlier turn; several rows of a turn are alternative replies, numbered by role and
    text, and the next turn answers the first of them.  Its score is the number of its characters.
    """
    rows = conversations.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").repartition("conv_id").distinct()  # all below is by conversation
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.withColumn("id", F.row_number().over(order).cast("long"))
    first = F.min("id").over(Window.partitionBy("conv_id", "turn"))
    before = numbered.withColumn("first", first)
    last = F.last(F.when(F.col("first") == F.col("id"), F.col("id")), ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    return before.withColumn("parent", last).select(F.col("conv_id").alias("tree"), "id", "parent", "role", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("score"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best branches of every conversation, each formatted as one text."""
    return format_trees(from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).withColumnRenamed("tree", "conv_id")


ORACLE = """
WITH RECURSIVE n AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS id
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
 f AS (SELECT *, min(id) OVER (PARTITION BY conv_id, turn) AS first FROM n),
 p AS (SELECT a.*, (SELECT max(b.id) FROM f b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.id = b.first) AS parent FROM f a),
 r AS (
  SELECT conv_id, id, CAST([id] AS BIGINT[]) AS path, length(text) AS score, 1 AS n_messages,
   '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS conversation FROM p WHERE parent IS NULL
  UNION ALL
  SELECT p.conv_id, p.id, list_append(r.path, p.id), r.score + length(p.text), r.n_messages + 1,
   r.conversation || '<|im_start|>' || p.role || chr(10) || p.text || '<|im_end|>' || chr(10)
  FROM r JOIN p ON p.conv_id = r.conv_id AND p.parent = r.id),
 leaf AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, path) AS branch_rank FROM r
  WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.conv_id = r.conv_id AND p.parent = r.id))
SELECT conv_id, CAST(branch_rank AS INTEGER) AS branch_rank, id AS leaf, CAST(n_messages AS INTEGER) AS n_messages,
 CAST(score AS BIGINT) AS score, conversation FROM leaf WHERE branch_rank <= 3
"""
