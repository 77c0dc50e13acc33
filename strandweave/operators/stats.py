"""Summaries of files, counts and typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F


def count_histogram(nodes: DataFrame) -> DataFrame:
    """(count, nodes)."""
    return nodes.groupBy("count").agg(F.count("*").alias("nodes"))


def quadratic_edge(count):
    """The smallest of the edges 1, 2, 4, 6, 9, 12, ... that isn't below a count: floor((t + 1)**2 / 4) for the smallest such t."""
    edge = lambda t: F.floor((t + 1) * (t + 1) / 4)
    guess = F.greatest(F.ceil(2 * F.sqrt(count)) - 2, F.lit(1)).cast("long")
    return F.least(*[F.when(edge(guess + d) >= count, edge(guess + d)) for d in range(4)]).cast("long")


def quadratic_histogram(nodes: DataFrame) -> DataFrame:
    """(edge, nodes): counts in bins whose width grows with the square root; edge is the bin's upper end."""
    return count_histogram(nodes).groupBy(quadratic_edge(F.col("count")).alias("edge")).agg(F.sum("nodes").alias("nodes"))


def histogram_summary(nodes: DataFrame) -> DataFrame:
    """(n, total, mean, median, n50): median and N50 scanned from the largest count down, each one above where half is reached.

    Only the histogram is ordered, one row for each distinct count.
    """
    h = count_histogram(nodes).where(F.col("count") > 0)
    down = Over.orderBy(F.desc("count"))
    all_ = Over.partitionBy()
    h = h.withColumn("n_to", F.sum("nodes").over(down)).withColumn("t_to", F.sum(F.col("nodes") * F.col("count")).over(down))
    h = h.withColumn("n", F.sum("nodes").over(all_)).withColumn("total", F.sum(F.col("nodes") * F.col("count")).over(all_))
    half = lambda part, whole: F.max(F.when(2 * F.col(part) >= F.col(whole), F.col("count"))) + 1
    return h.agg(F.max("n").alias("n"), F.max("total").alias("total"), F.round(F.max("total") / F.max("n"), 6).alias("mean"), half("n_to", "n").alias("median"), half("t_to", "total").alias("n50"))


def file_summary(seqs: DataFrame, occurrences: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, sequences, bases, fragments, new, coverage): a row for each file and one, with null, for all, which has the fragments of a node on average."""
    of_seq = occurrences.where("NOT poly").groupBy("seq_ord").agg(F.count("*").alias("fragments"))
    fresh = nodes.groupBy(F.col("first_seq").alias("seq_ord")).agg(F.count("*").alias("new"))
    rows = seqs.select("seq_ord", "file", "len").join(of_seq, "seq_ord", "left").join(fresh, "seq_ord", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    mean = F.when((F.grouping("file") == 1) & (F.sum("new") > 0), F.round(F.coalesce(F.sum("fragments"), F.lit(0)) / F.sum("new"), 6)).alias("coverage")
    return rows.rollup("file").agg(F.count("*").alias("sequences"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("bases"), total("fragments"), total("new"), mean)


def base_skew(nodes: DataFrame) -> DataFrame:
    """(most, nodes): histogram of the larger number of c or g of each node's text (node, canon as text)."""
    n = lambda c: F.length("canon") - F.length(F.replace("canon", F.lit(c), F.lit("")))
    return nodes.groupBy(F.greatest(n("c"), n("g")).cast("long").alias("most")).agg(F.count("*").alias("nodes"))


def line_statistics(lines: DataFrame) -> DataFrame:
    """(line_type, count, longest, total) of typed lines (line_type, size)."""
    return lines.groupBy("line_type").agg(F.count("*").alias("count"), F.max("size").cast("long").alias("longest"), F.sum("size").cast("long").alias("total"))


def line_statistics_per_object(lines: DataFrame) -> DataFrame:
    """(line_type, most, most_total): the largest count and total size of a line type in one object (object, line_type, size)."""
    one = lines.groupBy("object", "line_type").agg(F.count("*").alias("n"), F.sum("size").alias("t"))
    return one.groupBy("line_type").agg(F.max("n").alias("most"), F.max("t").cast("long").alias("most_total"))
