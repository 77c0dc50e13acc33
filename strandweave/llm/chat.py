"""Operator 9: reply trees into formatted conversations, with DataFrame operations only.

Messages form trees by a parent key.  Iterative self-joins that double the
distance looked back enumerate the root-to-leaf paths (a path of n messages
takes log2(n) rounds); branches are ranked by the sum of their messages' scores, and the best
are formatted, each as one conversation.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.  A control
string inside a text gets a backslash behind its first character (and one more
if it has some), which is undone by taking one away; so no text can hold a
marker.  In a role, backslashes and line feeds are written as ``\\s`` and ``\\n``
first.  The loss mask is a list of spans [start, end) in code points that cover
the assistant texts as written.

Defined results: null text is empty, null role is an empty role; rows of one
conversation with the same turn follow by role and then text; a null turn comes
first; rows with a null conv_id form one conversation; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from strandweave.runtime import Workspace

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What a text may not hold as it is, split behind the first character.
CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]"
_ESCAPE = rf"([<\[])(\\*)({CONTROL})"
_UNESCAPE = rf"([<\[])\\(\\*)({CONTROL})"
LEARNED = "assistant"


def escape(text):
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescape(text):
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def escape_role(role):
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role):
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def paths(ws: Workspace, messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, branch_rank, node, depth) of root-to-leaf paths of messages (tree, node, parent, score).

    A message whose parent is null or missing is a root.  Round k joins each
    message that has one with that 2**k steps above, which gives depths, sums of
    scores and a table of jumps of that length; rows are of fixed size.  From the leaves
    chosen, the jump tables are then followed from the longest to the shortest,
    each adding the messages that far above: the rows made are those of the
    result.  Messages on or below a cycle never reach a root and are in no path.
    """
    known = messages.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    base = messages.join(known, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("p")), "left")
    base = ws.put(base.select("tree", "node", F.col("p").alias("up"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"), F.lit(1).cast("long").alias("depth")), "jumps")
    limit, tables = base.count(), [base]
    ended = base.where("up IS NULL")
    while (1 << (len(tables) - 1)) <= limit and not (open_ := tables[-1].where("up IS NOT NULL")).isEmpty():
        above = ended.unionByName(open_).select(F.col("tree").alias("t"), F.col("node").alias("p"), F.col("up").alias("further"), F.col("total").alias("more"), F.col("depth").alias("higher"))
        step = open_.join(above, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("p")))
        tables.append(ws.put(step.select("tree", "node", F.col("further").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("higher")).alias("depth")), "jumps"))
        ended = ended.unionByName(tables[-1].where("up IS NULL"))
    jumps = [t.where("up IS NOT NULL").select("tree", "node", "up") for t in tables[:-1]]
    parents = messages.where("parent IS NOT NULL").select(F.col("tree").alias("t"), F.col("parent").alias("p")).distinct()
    leaves = ended.join(parents, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    ranked = leaves.withColumn("branch_rank", F.row_number().over(Over.partitionBy("tree").orderBy(F.desc("total"), F.asc("node"))))
    if best is not None:
        ranked = ranked.where(F.col("branch_rank") <= best)
    found = ranked.select("tree", F.col("node").alias("leaf"), "branch_rank", "node")
    for up in reversed(jumps):
        found = found.join(up, ["tree", "node"], "left").select("tree", "leaf", "branch_rank", F.explode(F.array_compact(F.array("node", "up"))).alias("node"))
    return found.join(ended.select("tree", "node", "depth"), ["tree", "node"])


def format_turns(turns):
    """Of an array of (role, text): (formatted, loss), loss being an array of (start, end) in code points."""
    written = F.transform(turns, lambda t: F.struct((t.role == LEARNED).alias("learned"), F.concat(F.lit(OPEN), escape_role(t.role), F.lit("\n")).alias("head"), escape(t.text).alias("body")))
    formatted = F.array_join(F.transform(written, lambda w: F.concat(w.head, w.body, F.lit(CLOSE + "\n"))), "")
    tail = len(CLOSE) + 1
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def add(acc, w):
        start = acc.at + F.length(w.head)
        end = start + F.length(w.body)
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + tail).alias("at"), F.when(w.learned, F.concat(acc.spans, span)).otherwise(acc.spans).alias("spans"))

    return formatted, F.aggregate(written, zero, add, lambda acc: acc.spans)


def format_trees(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, branch_rank, formatted, loss) of messages (tree, node, parent, score, role, text).

    ``best`` is the number of branches of a tree that are formatted, None for
    all; node is unique in its tree.
    """
    ws = Workspace(messages.sparkSession, "chat")
    found = paths(ws, messages.select("tree", "node", "parent", "score"), best)
    said = messages.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = found.join(said, ["tree", "node"]).groupBy("tree", "leaf", "branch_rank").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    formatted, loss = format_turns(F.col("turns"))
    return turns.select("tree", "leaf", "branch_rank", formatted.alias("formatted"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the learned text that formatted conversations hold, with all columns of the input."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>"), 2, 1 << 30)
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(_body(p)).alias("text"),
        ),
    )
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
    return formatted.withColumn("turns", turns).withColumn("learned", learned)


def _body(piece):
    head = F.length(F.substring_index(piece, "\n", 1)) + 1
    return F.substring(piece, head + 1, F.length(piece) - head - (len(CLOSE) + 1))


def as_chains(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as messages, each turn the reply to the one before."""
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    order = Over.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", tree.alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def digest(formatted: DataFrame) -> DataFrame:
    """The contract's columns, from what is read back."""
    back = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        F.when(F.col("tree") != "none", F.col("tree")).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
