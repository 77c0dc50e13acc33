"""Queries against the paths: maximal exact matches, what is missing, unique places, filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from strandweave.functions import dna
from strandweave.operators import walks
from strandweave.params import SampleParams
from strandweave.runtime import Workspace

#: Longest run of g and least mean quality of the preset for short reads.
SHORT_READS = {"poly_g": 60, "quality": 20.0}


def blocks(found: DataFrame) -> DataFrame:
    """(query, blk, c, pos, node, gap) of query occurrences (seq_ord, pos, node, poly): chains without unknown or homopolymer fragments.

    ``found`` keeps homopolymers and unknown fragments (node 0), which end a chain.
    """
    order = Over.partitionBy("seq_ord").orderBy("pos")
    bad = F.col("poly") | (F.col("node") == 0)
    rows = found.withColumn("blk", F.sum(bad.cast("long")).over(order)).where(~bad)
    inside = Over.partitionBy("seq_ord", "blk").orderBy("pos")
    return rows.select(F.col("seq_ord").alias("query"), "blk", (F.row_number().over(inside) - 1).cast("long").alias("c"), "pos", "node", F.coalesce(F.col("pos") - F.lag("pos").over(inside), F.lit(0)).alias("gap"))


def _walked(rows: DataFrame, by: list[str], at: str, gap) -> DataFrame:
    """rows' walks (nodes, gaps), each in one row; gap gives a visit's from the visit, the visit before and its number."""
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(at, *[c for c in ("node", "gap", "pos") if c in rows.columns]))).alias("v"))
    gaps = F.transform("v", lambda v, i: gap(v, F.get("v", i - 1), i).cast("long"))
    return lists.select(*by, F.transform("v", lambda v: v["node"].cast("long")).alias("nodes"), gaps.alias("gaps"))


def matches(chains: DataFrame, visited: DataFrame) -> DataFrame:
    """(query, blk, first, last, count): maximal exact matches of chains against the paths of both strands.

    visited has visits (path_id, idx, node, pos) or whole paths (nodes, gaps).  From
    each fragment of a chain the longest chain that paths have is looked for, on both
    strands; those inside others of their chain go.  What stays is the longest from
    its first fragment, so it is counted as often as its chain stands in the paths:
    no visit of a path ever meets a query as a row.
    """
    ws = Workspace(chains.sparkSession, "matches")
    queries = _walked(chains.select("query", "blk", "c", "node", "gap"), ["query", "blk"], "c", lambda v, before, i: v["gap"])
    queries = ws.put(queries.withColumn("q", F.monotonically_increasing_id()), "queries")
    if "nodes" not in visited.columns:
        visited = _walked(visited.select("path_id", "idx", "node", "pos"), ["path_id"], "idx", lambda v, before, i: F.when(i == 0, 0).otherwise(v["pos"] - before["pos"]))
    return walks.maximal(walks.longest(ws, queries, ws.put(visited.select("nodes", "gaps"), "paths")))


def match_positions(found: DataFrame, chains: DataFrame, p: SampleParams) -> DataFrame:
    """(query, start, end, count): matches in bases of the query."""
    at = chains.select("query", "blk", "c", "pos")
    out = found.join(at.select("query", "blk", F.col("c").alias("first"), F.col("pos").alias("start")), ["query", "blk", "first"])
    out = out.join(at.select("query", "blk", F.col("c").alias("last"), (F.col("pos") + p.length).alias("end")), ["query", "blk", "last"])
    return out.select("query", "start", "end", "count")


def missing(found: DataFrame, p: SampleParams) -> DataFrame:
    """(query, pos, dna) of query fragments that the dictionary lacks, as the query has them."""
    text = dna.unpacked(F.col("canon"), p.length)
    return found.where("node = 0 AND NOT poly").select(F.col("seq_ord").alias("query"), "pos", F.when(F.col("orient") < 0, dna.reverse_complement(text)).otherwise(text).alias("dna"))


def unique_places(found: DataFrame, chains: DataFrame, nodes: DataFrame, p: SampleParams) -> DataFrame:
    """(query, start, end, place, strand): matches placed by their first fragment that occurs once in all sequences.

    place is the match's start among all bases of the forward strand.
    """
    once = nodes.where("count = 1").select(F.col("node").alias("_n"), "loc", "first_orient")
    held = chains.join(once, F.abs("node") == F.col("_n"))
    spans = found.join(held.select("query", "blk", "c", F.col("pos").alias("at"), "node", "loc", "first_orient"), ["query", "blk"]).where("c BETWEEN first AND last")
    best = Over.partitionBy("query", "blk", "first", "last").orderBy("c")
    spans = spans.withColumn("_k", F.row_number().over(best)).where("_k = 1")
    at = chains.select("query", "blk", "c", "pos")
    spans = spans.join(at.select("query", "blk", F.col("c").alias("first"), F.col("pos").alias("start")), ["query", "blk", "first"])
    spans = spans.join(at.select("query", "blk", F.col("c").alias("last"), (F.col("pos") + p.length).alias("end")), ["query", "blk", "last"])
    strand = F.when(F.signum("node") == F.col("first_orient"), 1).otherwise(-1)
    ahead = F.col("at") - F.col("start")
    place = F.when(strand > 0, F.col("loc") - ahead).otherwise(F.col("loc") + p.length + ahead - (F.col("end") - F.col("start")))
    return spans.select("query", "start", "end", place.cast("long").alias("place"), strand.alias("strand"))


def output(queries: DataFrame, found: DataFrame, lacking: DataFrame, placed: DataFrame, ids: bool = True) -> DataFrame:
    """One row for each query (query, len, id, code): its matches, missing fragments and unique places as arrays, in order of place.

    ``found`` comes from match_positions, ``lacking`` from missing, ``placed`` from
    unique_places; without ``ids`` the queries' names are left out.
    """
    def listed(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != "query"]))).alias(name))

    out = queries.select("query", "len", *(["id"] if ids else []), *(["code"] if "code" in queries.columns else []))
    for rows, name in ((found, "matches"), (lacking, "missing"), (placed, "places")):
        out = out.join(listed(rows, name), "query", "left").withColumn(name, F.coalesce(name, F.array()))
    return out


def totals(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(matches, mean_length, mean_count, without): over positions of matches and the queries (query)."""
    some = found.select("query").distinct().withColumn("hit", F.lit(1))
    lone = queries.select("query").join(some, "query", "left").agg(F.coalesce(F.sum(F.when(F.col("hit").isNull(), 1)), F.lit(0)).cast("long").alias("without"))
    sums = found.agg(F.count("*").alias("matches"), F.round(F.avg(F.col("end") - F.col("start")), 6).alias("mean_length"), F.round(F.avg("count"), 6).alias("mean_count"))
    return sums.withColumn("_one", F.lit(1)).join(lone.withColumn("_one", F.lit(1)), "_one").drop("_one")


def with_match(occurrences: DataFrame, known: DataFrame) -> DataFrame:
    """(query): queries with a match, from their fragments and those of the visited nodes (canon); no path is read.

    A visited fragment matches by itself if nothing around it does, so one is enough.
    """
    return occurrences.where("NOT poly").join(known.select("canon"), "canon", "left_semi").select(F.col("seq_ord").alias("query"))


def without_match(found: DataFrame, queries: DataFrame) -> DataFrame:
    return queries.join(found.select("query").distinct(), "query", "left_anti")


def filter_code(reads: DataFrame, poly_g: int | None = None, quality: float | None = None) -> DataFrame:
    """reads (seq, qual) with code: Q for a mean quality over 0 and below the limit, else G for a run of more than poly_g g, else null; empty reads pass."""
    code = F.lit(None).cast("string")
    if poly_g is not None:
        code = F.when(F.col("seq").rlike(f"g{{{poly_g + 1},}}"), "G")
    if quality is not None:
        mean = dna.mean_quality(F.col("qual"))
        code = F.coalesce(F.when((mean > 0) & (mean < quality), "Q"), code)
    return reads.withColumn("code", code)


def passing(reads: DataFrame, poly_g: int | None = None, quality: float | None = None) -> DataFrame:
    return filter_code(reads, poly_g, quality).where("code IS NULL").drop("code")
