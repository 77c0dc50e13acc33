"""The bidirectional graph of paths: edges, starts, classes of nodes and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from strandweave.operators.pathing import both_strands


def edges(visited: DataFrame) -> DataFrame:
    """(node, adj, off, count): arrivals at each oriented node from the oriented node before it; adj 0 is a path's start.

    Both strands count, so the edge from a to b has the count of that from -b to -a.
    """
    return both_strands(visited).groupBy("node", "adj", F.col("gap").alias("off")).agg(F.count("*").alias("count"))


def start_counts(visited: DataFrame) -> DataFrame:
    """(node, starts): paths of either strand that begin at an oriented node."""
    return both_strands(visited).where("idx = 0").groupBy("node").agg(F.count("*").alias("starts"))


def start_numbers(visited: DataFrame) -> DataFrame:
    """(path_id, strand, node, number): which of the paths that begin at a node a path is, from 0."""
    order = Over.partitionBy("node").orderBy("path_id", F.desc("strand"))
    return both_strands(visited).where("idx = 0").select("path_id", "strand", "node", (F.row_number().over(order) - 1).cast("long").alias("number"))


def sides(edges_: DataFrame) -> DataFrame:
    """(node, side, n_edges, visits): of the unsigned node, side 'in' for arrivals at +node and 'out' for those at -node."""
    side = F.when(F.col("node") > 0, "in").otherwise("out")
    return edges_.groupBy(F.abs("node").alias("node"), side.alias("side")).agg(F.count("*").alias("n_edges"), F.sum("count").alias("visits"))


def node_classes(edges_: DataFrame) -> DataFrame:
    """(node, in_edges, out_edges, class): both sides simple, one, or none."""
    one = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n_edges"))), F.lit(0)).cast("long")
    rows = sides(edges_).groupBy("node").agg(one("in").alias("in_edges"), one("out").alias("out_edges"))
    simple_in, simple_out = F.col("in_edges") == 1, F.col("out_edges") == 1
    return rows.withColumn("class", F.when(simple_in & simple_out, "simple").when(simple_in, "simple_in").when(simple_out, "simple_out").otherwise("complex"))


def blank_nodes(edges_: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): nodes of the dictionary that no path visits."""
    return nodes.select("node").join(edges_.select(F.abs("node").alias("node")).distinct(), "node", "left_anti")


def statistics(edges_: DataFrame) -> DataFrame:
    """(stat, value): figures of the whole graph; a side with one edge is simple.

    Ids up to the largest that no path visits are blank nodes.  The expected
    search time weighs an edge's place in its side's directory, which is in the
    order of gap and adjacent node, with its count; like the largest count of an
    edge and the most paths through a side it is taken over complex sides.
    """
    s = sides(edges_)
    complex_ = F.col("n_edges") > 1
    of_sides = s.agg(
        F.countDistinct("node").alias("nodes"),
        (F.max("node") - F.countDistinct("node")).alias("blank_nodes"),
        F.coalesce(F.sum(F.when(F.col("n_edges") == 1, 1)), F.lit(0)).alias("simple_sides"),
        F.coalesce(F.sum(F.when(complex_, 1)), F.lit(0)).alias("complex_sides"),
        (F.coalesce(F.sum(F.when(complex_, 1)), F.lit(0)) / (2 * F.max("node")) * 100).alias("complex_percent"),
        F.max("n_edges").alias("max_edge_list"),
        F.max(F.when(complex_, F.col("visits"))).alias("max_paths_through"),
    )
    here = Over.partitionBy("node")
    ranked = edges_.withColumn("place", F.row_number().over(here.orderBy("off", "adj"))).withColumn("n", F.count("*").over(here))
    several = F.col("n") > 1
    of_edges = ranked.agg(
        F.max(F.when(several, F.col("count"))).alias("max_edge_count"),
        F.count("*").alias("edge_lines"),
        F.floor(F.count("*") / 2).alias("edges"),
        F.floor(F.coalesce(F.sum(F.when(F.col("adj") == 0, F.col("count"))), F.lit(0)) / 2).alias("sequences"),
        (F.sum(F.when(several, F.col("count") * F.col("place"))) / F.sum(F.when(several, F.col("count")))).alias("expected_search"),
    )
    return _melted(of_sides).unionByName(_melted(of_edges))


def _melted(row: DataFrame) -> DataFrame:
    """(stat, value) of a one-row table."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("stat"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in row.columns]))
    return row.select(pairs.alias("x")).select("x.*")


def edge_list_lengths(edges_: DataFrame, top: int = 20) -> DataFrame:
    """(length, sides): how many sides have so many edges; ``top`` stands for that many and more."""
    return sides(edges_).groupBy(F.least("n_edges", F.lit(top)).cast("long").alias("length")).agg(F.count("*").alias("sides"))
