"""The path index: visits of every node in co-lexicographic order, with what follows from it.

A visit's symbol is (node, gap to the visit before).  The visits of a node are
ordered by their symbols read backwards to the path's start; equal histories go
by path and strand.  All successors of a node in that order are its run-length
coded list; rank and select on it, and following paths through it, are window
functions and joins here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from strandweave.operators.pathing import both_strands
from strandweave.runtime import Workspace

#: Symbols compared in the first round; each later round doubles the length.
FIRST = 4


def visit_order(ws: Workspace, visited: DataFrame) -> DataFrame:
    """(path_id, strand, idx, node, adj, gap, place): place is a visit's number among those of its oriented node, from 0.

    Prefix doubling: ranks of the last h symbols give ranks of the last 2h.  A
    visit's rank is the number of visits of its node that come before all that
    are alike so far, so node and rank compare histories, and ranks stay when
    others are told apart.  Only visits that are alike and whose history goes on
    are ranked anew, and a path without such leaves the rounds.
    """
    along = Over.partitionBy("path_id", "strand").orderBy("idx")
    back = [F.lag(c, k).over(along).alias(f"_{c}{k}") for k in range(1, FIRST) for c in ("node", "gap")]
    rows = both_strands(visited).select("path_id", "strand", "idx", "node", "adj", "gap", *back)
    key = ["gap", *(f"_{c}{k}" for k in range(1, FIRST) for c in ("node", "gap"))]
    rows = rows.withColumn("rank", (F.rank().over(Over.partitionBy("node").orderBy(*key)) - 1).cast("long")).withColumn("_alike", F.count("*").over(Over.partitionBy("node", *key)))
    now = ws.put(rows.select(*_VISIT, "rank", _open(FIRST)), "ranks")
    h, done = FIRST, []
    while not now.where("open").isEmpty():
        live = F.max("open").over(Over.partitionBy("path_id", "strand"))
        before = [F.lag(c, h).over(along).alias(f"_before_{c}") for c in ("node", "rank")]
        told = ws.put(now.select(*_VISIT, "rank", "open", live.alias("_live"), *before), "ranks")
        ws.drop(now)
        here, deeper = Over.partitionBy("node", "rank"), ["_before_node", "_before_rank"]
        again = told.where("open").withColumn("_more", (F.rank().over(here.orderBy(*deeper)) - 1).cast("long")).withColumn("_alike", F.count("*").over(Over.partitionBy("node", "rank", *deeper)))
        h *= 2
        again = again.select(*_VISIT, (F.col("rank") + F.col("_more")).alias("rank"), _open(h))
        now = ws.put(again.unionByName(told.where("_live AND NOT open").select(*_VISIT, "rank", "open")), "ranks")
        done.append(told.where("NOT _live").select(*_VISIT, "rank"))
    ranked = now.select(*_VISIT, "rank")
    for part in done:
        ranked = ranked.unionByName(part)
    order = Over.partitionBy("node").orderBy("rank", "path_id", "strand")
    return ranked.withColumn("place", (F.row_number().over(order) - 1).cast("long")).drop("rank")


_VISIT = ("path_id", "strand", "idx", "node", "adj", "gap")


def _open(h: int):
    """Whether visits that are alike in h symbols may differ further back: equal histories that have ended stay equal."""
    return ((F.col("_alike") > 1) & (F.col("idx") >= h)).alias("open")


def successors(ordered: DataFrame) -> DataFrame:
    """(node, place, next_node, next_gap): what follows each visit; 0 and 0 at a path's end."""
    along = Over.partitionBy("path_id", "strand").orderBy("idx")
    return ordered.select("node", "place", *(F.coalesce(F.lead(c).over(along), F.lit(0)).cast("long").alias(f"next_{c}") for c in ("node", "gap")))


def runs(lists: DataFrame) -> DataFrame:
    """(node, run_no, next_node, next_gap, run_len): successor lists run-length coded."""
    order = Over.partitionBy("node").orderBy("place")
    changed = F.coalesce((F.lag("next_node").over(order) != F.col("next_node")) | (F.lag("next_gap").over(order) != F.col("next_gap")), F.lit(True))
    rows = lists.withColumn("run_no", F.sum(changed.cast("long")).over(order) - 1)
    return rows.groupBy("node", "run_no", "next_node", "next_gap").agg(F.count("*").alias("run_len"))


def expand(run_lists: DataFrame) -> DataFrame:
    """(node, place, next_node, next_gap): the lists that runs stand for."""
    order = Over.partitionBy("node").orderBy("run_no")
    start = F.sum("run_len").over(order) - F.col("run_len")
    return run_lists.withColumn("start", start).select("node", F.explode(F.sequence("start", F.col("start") + F.col("run_len") - 1)).alias("place"), "next_node", "next_gap")


def ranks(lists: DataFrame) -> DataFrame:
    """lists with rank: how often a visit's symbol occurs before it; find(at) is the row, rank its number."""
    order = Over.partitionBy("node", "next_node", "next_gap").orderBy("place")
    return lists.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def rank_of(run_lists: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (node, place, next_node, next_gap) with rank: occurrences of the symbol in the first ``at`` entries, from runs."""
    order = Over.partitionBy("node").orderBy("run_no")
    spans = run_lists.withColumn("start", F.sum("run_len").over(order) - F.col("run_len")).select("node", "next_node", "next_gap", "start", "run_len")
    asked = asked.withColumn("_row", F.monotonically_increasing_id())
    hit = asked.join(spans, ["node", "next_node", "next_gap"], "left")
    part = F.greatest(F.lit(0), F.least(F.col("run_len"), F.col("place") - F.col("start")))
    return hit.groupBy("_row", "node", "place", "next_node", "next_gap").agg(F.coalesce(F.sum(part), F.lit(0)).cast("long").alias("rank")).drop("_row")


def counts(run_lists: DataFrame) -> DataFrame:
    """(node, next_node, next_gap, count): occurrences of each symbol of each list."""
    return run_lists.groupBy("node", "next_node", "next_gap").agg(F.sum("run_len").alias("count"))


def lengths(run_lists: DataFrame) -> DataFrame:
    """(node, length, n_symbols) of the lists."""
    return run_lists.groupBy("node").agg(F.sum("run_len").alias("length"), F.count_distinct("next_node", "next_gap").alias("n_symbols"))


def directory_ranks(edges: DataFrame) -> DataFrame:
    """edges with before: the sum of counts of the edges listed before, by gap and adjacent node."""
    order = Over.partitionBy("node").orderBy("off", "adj").rowsBetween(Over.unboundedPreceding, -1)
    return edges.withColumn("before", F.coalesce(F.sum("count").over(order), F.lit(0)).cast("long"))


def follow(lists: DataFrame) -> DataFrame:
    """(node, place, next_node, next_place): where each visit leads, from the lists alone.

    The visits of a node are sorted by gap, then by the node before and its
    place; so a visit's place is the number of arrivals listed before its own edge
    plus the rank of its symbol among those of the node before.
    """
    ranked = ranks(lists).where("next_node <> 0")
    arrivals = ranked.groupBy(F.col("next_node").alias("n"), F.col("next_gap").alias("g"), F.col("node").alias("a")).agg(F.count("*").alias("c"))
    starts = lists.groupBy(F.col("node").alias("n")).agg(F.count("*").alias("all")).join(arrivals.groupBy("n").agg(F.sum("c").alias("came")), "n", "left")
    starts = starts.select("n", (F.col("all") - F.coalesce("came", F.lit(0))).alias("first"))
    order = Over.partitionBy("n").orderBy("g", "a").rowsBetween(Over.unboundedPreceding, -1)
    base = arrivals.withColumn("base", F.coalesce(F.sum("c").over(order), F.lit(0))).join(starts, "n")
    out = ranked.join(base, (F.col("next_node") == F.col("n")) & (F.col("next_gap") == F.col("g")) & (F.col("node") == F.col("a")))
    # Starts have gap 0 and nothing before them, so they come first among gap 0; no arrival of a path has gap 0 unless gaps may be 0.
    return out.select("node", "place", "next_node", (F.col("first") + F.col("base") + F.col("rank")).cast("long").alias("next_place"))


def walk(ws: Workspace, lists: DataFrame) -> DataFrame:
    """(start_node, start_place, step, node): every path, followed through the lists from its start.

    Pointers are doubled, so a path of n visits takes log2(n) rounds.
    """
    step = follow(lists)
    here = lists.select("node", "place").join(step.select(F.col("next_node").alias("node"), F.col("next_place").alias("place"), F.struct(F.col("node").alias("n"), F.col("place").alias("a")).alias("up")), ["node", "place"], "left")
    now = ws.put(here.withColumn("steps", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long")).withColumn("root", F.coalesce("up", F.struct(F.col("node").alias("n"), F.col("place").alias("a")))), "walk")
    while not now.where("up IS NOT NULL").isEmpty():
        above = now.select(F.col("node").alias("_n"), F.col("place").alias("_a"), F.col("up").alias("_up"), F.col("steps").alias("_steps"), F.col("root").alias("_root"))
        j = now.join(above, (F.col("up.n") == F.col("_n")) & (F.col("up.a") == F.col("_a")), "left")
        following = ws.put(j.select("node", "place", F.col("_up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_root", "root").alias("root")), "walk")
        ws.drop(now)
        now = following
    return now.select(F.col("root.n").alias("start_node"), F.col("root.a").alias("start_place"), F.col("steps").alias("step"), "node")


def insert(lists: DataFrame, added: DataFrame) -> DataFrame:
    """lists (node, place, next_node, next_gap) with added rows, whose place is that among the list as it is.

    What stood at the place and behind moves on; of several added at one place the
    one with the smaller symbol comes first.  A place behind the end means the end.
    """
    columns = ["node", "place", "next_node", "next_gap"]
    both = lists.select(*columns, F.lit(1).alias("_old")).unionByName(added.select(*columns, F.lit(0).alias("_old")))
    order = Over.partitionBy("node").orderBy("place", "_old", "next_node", "next_gap")
    return both.withColumn("place", (F.row_number().over(order) - 1).cast("long")).select(*columns)


def ranges(run_lists: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, node, low, high) of asked (id, node): all visits of a node, where a match begins."""
    return asked.join(lengths(run_lists).select("node", "length"), "node").select("id", "node", F.lit(0).cast("long").alias("low"), F.col("length").cast("long").alias("high"))


def arrivals(run_lists: DataFrame) -> DataFrame:
    """(node, next_node, next_gap, base): the place, among the next node's visits, of the first that comes from a node by a gap."""
    came = counts(run_lists).where("next_node <> 0").withColumnsRenamed({"node": "a", "next_node": "n", "next_gap": "g", "count": "c"})
    whole = lengths(run_lists).select(F.col("node").alias("n"), "length").join(came.groupBy("n").agg(F.sum("c").alias("came")), "n")
    order = Over.partitionBy("n").orderBy("g", "a").rowsBetween(Over.unboundedPreceding, -1)
    base = came.withColumn("before", F.coalesce(F.sum("c").over(order), F.lit(0))).join(whole, "n")
    return base.select(F.col("a").alias("node"), F.col("n").alias("next_node"), F.col("g").alias("next_gap"), (F.col("length") - F.col("came") + F.col("before")).cast("long").alias("base"))


def narrow(run_lists: DataFrame, bases: DataFrame, now: DataFrame) -> DataFrame:
    """(id, node, low, high): ranges (id, node, low, high, next_node, next_gap) after one more step; those that end empty are left out.

    Runs of a node and its range meet on the node and the symbol, so a step reads
    the runs of that symbol and no visits.
    """
    order = Over.partitionBy("node").orderBy("run_no")
    spans = run_lists.withColumn("start", F.sum("run_len").over(order) - F.col("run_len")).select("node", "next_node", "next_gap", "start", "run_len")
    hit = now.join(spans, ["node", "next_node", "next_gap"])
    upto = lambda c: F.sum(F.greatest(F.lit(0), F.least(F.col("run_len"), F.col(c) - F.col("start")))).cast("long").alias(c)
    ranked = hit.groupBy("id", "node", "next_node", "next_gap").agg(upto("low"), upto("high")).where("low < high")
    out = ranked.join(bases, ["node", "next_node", "next_gap"])
    return out.select("id", F.col("next_node").alias("node"), (F.col("base") + F.col("low")).alias("low"), (F.col("base") + F.col("high")).alias("high"))


def narrow_chain(ws: Workspace, run_lists: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, node, low, high, count) of chains (id, chain), chain an array of (node, gap): the places of the visits at which each ends.

    All chains go a step together; a round for each step of the longest.  Chains
    that occur nowhere are left out.
    """
    bases = ws.put(arrivals(run_lists), "arrivals")
    now = ws.put(ranges(run_lists, asked.select("id", F.col("chain")[0]["node"].alias("node"))), "ranges")
    longest = asked.agg(F.max(F.size("chain")).alias("n")).first().n or 0
    for k in range(1, longest):
        step = asked.where(F.size("chain") > k).select("id", F.col("chain")[k]["node"].alias("next_node"), F.col("chain")[k]["gap"].alias("next_gap"))
        still = now.join(asked.where(F.size("chain") <= k).select("id"), "id", "left_semi")
        now = ws.put(narrow(run_lists, bases, now.join(step, "id")).unionByName(still), "ranges")
    return now.withColumn("count", F.col("high") - F.col("low"))


def chains(visited: DataFrame, length: int) -> DataFrame:
    """(nodes, gaps, count): how often each chain of ``length`` visits with its gaps occurs on either strand."""
    along = Over.partitionBy("path_id", "strand").orderBy("idx")
    rows = both_strands(visited)
    nodes = F.array(*[F.lead("node", k).over(along) if k else F.col("node") for k in range(length)])
    gaps = F.array(*[F.lead("gap", k).over(along) for k in range(1, length)]) if length > 1 else F.array().cast("array<bigint>")
    rows = rows.select(nodes.alias("nodes"), gaps.alias("gaps")).where(F.element_at("nodes", -1).isNotNull())
    return rows.groupBy("nodes", "gaps").agg(F.count("*").alias("count"))


def match_range(ordered: DataFrame, chain: list[tuple[int, int]]) -> DataFrame:
    """(node, low, high, count) of a chain [(node, gap), ...]: the places of the visits at which it ends; the first gap is not looked at."""
    along = Over.partitionBy("path_id", "strand").orderBy("idx")
    test = F.lit(True)
    for back, (node, gap) in enumerate(reversed(chain)):
        n, g = (F.lag(c, back).over(along) if back else F.col(c) for c in ("node", "gap"))
        test = test & F.coalesce(n == node, F.lit(False)) & (F.coalesce(g == gap, F.lit(False)) if back < len(chain) - 1 else F.lit(True))
    return ordered.withColumn("_ok", test).where("_ok").groupBy("node").agg(F.min("place").alias("low"), (F.max("place") + 1).alias("high"), F.count("*").alias("count"))


def locate(places: DataFrame, starts: DataFrame, width: int = 1 << 16) -> DataFrame:
    """places (place, ...) with (file, path_id, offset): which sequence a signed place among all bases lies in.

    starts has (path_id, file, start, len).  Sequences and places meet in bins of
    ``width`` bases; a place beyond the end has nulls, the sign goes to offset.
    """
    spans = starts.where("len > 0").select("file", "path_id", F.col("start").alias("_start"), (F.col("start") + F.col("len")).alias("_stop"))
    spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_start") / width), F.floor((F.col("_stop") - 1) / width))))
    asked = places.withColumn("_at", F.floor(F.abs("place") / width))
    hit = asked.join(spans, (F.col("_at") == F.col("_bin")) & (F.abs("place") >= F.col("_start")) & (F.abs("place") < F.col("_stop")), "left")
    offset = F.when(F.col("place") < 0, F.col("_start") - F.abs("place")).otherwise(F.col("place") - F.col("_start"))
    return hit.select(*places.columns, "file", "path_id", offset.alias("offset"))
