"""The dictionary of sampled fragments: dense ids, signs, counts and places.

Nodes 1 and 2 are the homopolymers (a and t, c and g); real nodes follow from 3
in the order in which they first occur.  Fragments stay packed, two bits a base.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import dna
from strandweave.params import SampleParams
from strandweave.runtime import Workspace, maybe_in, membership, running_total

RESERVED, MOST_PER_FILE = 2, 127


def build(ws: Workspace, occurrences: DataFrame, seqs: DataFrame, after: int = RESERVED) -> DataFrame:
    """(node, canon, count, max_count, first_seq, first_pos, first_orient, loc) of occurrences (seq_ord, pos, canon, orient, poly).

    seqs has (seq_ord, file, start), start being the bases before a sequence.
    max_count is the largest count in one file, 127 at most; loc is the first
    occurrence's place among all bases.  Ids go on after ``after``.
    """
    real = occurrences.where("NOT poly").join(seqs.select("seq_ord", "file"), "seq_ord")
    of_file = real.groupBy("canon", "file").agg(F.count("*").alias("c"), F.min(F.struct("seq_ord", "pos", "orient")).alias("first"))
    nodes = of_file.groupBy("canon").agg(F.sum("c").alias("count"), F.max(F.least("c", F.lit(MOST_PER_FILE))).cast("int").alias("max_count"), F.min("first").alias("first"))
    nodes = nodes.select("canon", "count", "max_count", F.col("first.seq_ord").alias("first_seq"), F.col("first.pos").alias("first_pos"), F.when(F.col("first.orient") > 0, 1).otherwise(-1).alias("first_orient"))
    nodes = running_total(ws, nodes, ["first_seq", "first_pos"], name="rank").withColumn("node", F.col("rank") + 1 + after)
    nodes = nodes.join(seqs.select(F.col("seq_ord").alias("first_seq"), "start"), "first_seq")
    return nodes.select("node", "canon", "count", "max_count", "first_seq", "first_pos", "first_orient", (F.col("start") + F.col("first_pos")).alias("loc"))


def homopolymers(spark, p: SampleParams) -> DataFrame:
    """(node, canon, count) of the two reserved nodes."""
    texts = [("a" * p.length, 1), ("c" * p.length, 2)]
    return spark.createDataFrame(texts, "seq string, node long").select("node", dna.packed(F.col("seq")).alias("canon"), F.lit(0).cast("long").alias("count"))


def with_text(nodes: DataFrame, p: SampleParams) -> DataFrame:
    return nodes.withColumn("canon", dna.unpacked(F.col("canon"), p.length))


def node_text(nodes: DataFrame, wanted: DataFrame, p: SampleParams) -> DataFrame:
    """wanted (node, ...) with the text of each signed node; a node that isn't in the dictionary raises."""
    found = wanted.join(nodes.select(F.col("node").alias("_n"), "canon"), F.abs("node") == F.col("_n"), "left").drop("_n")
    text = dna.unpacked(F.col("canon"), p.length)
    told = F.when(F.col("canon").isNull(), F.raise_error(F.concat(F.lit("no such node: "), F.col("node").cast("string")))).when(F.col("node") < 0, dna.reverse_complement(text)).otherwise(text)
    return found.withColumn("text", told).drop("canon")


def look_up(occurrences: DataFrame, nodes: DataFrame) -> DataFrame:
    """occurrences without homopolymers and with their signed node, 0 for fragments that aren't in the dictionary."""
    known = nodes.select("canon", F.col("node").alias("_n"))
    return occurrences.where("NOT poly").join(known, "canon", "left").withColumn("node", F.coalesce(F.col("_n") * F.col("orient"), F.lit(0))).drop("_n")


def only_new(occurrences: DataFrame, nodes: DataFrame) -> DataFrame:
    """Occurrences whose fragment isn't in the dictionary."""
    return occurrences.join(nodes.select("canon"), "canon", "left_anti")


def shared(occurrences: DataFrame, others: DataFrame) -> DataFrame:
    """(canon): each fragment of ``others`` (canon, poly) that is also among occurrences, and a few more; homopolymers are left out.

    For questions that need neither ids nor counts: the others are filtered where
    they are found and go nowhere as rows.
    """
    return maybe_in(others.where("NOT poly").select("canon"), F.col("canon"), membership(occurrences, "canon"))[0].distinct()


def extend(ws: Workspace, nodes: DataFrame, occurrences: DataFrame, seqs: DataFrame) -> DataFrame:
    """nodes after counting more occurrences, with is_new; new ids go on after the largest.

    An old node keeps its id and its first place; its max_count is the larger of
    the old one and that of the new files.  Of nodes without max_count and places
    only node, canon and count are returned.
    """
    last = nodes.agg(F.max("node").alias("m")).first().m or RESERVED
    kept = [c for c in ("max_count", "first_seq", "first_pos", "first_orient", "loc") if c in nodes.columns]
    fresh = build(ws, only_new(occurrences, nodes), seqs, last).select("node", "canon", "count", *kept, F.lit(True).alias("is_new"))
    of_file = occurrences.where("NOT poly").join(seqs.select("seq_ord", "file"), "seq_ord").groupBy("canon", "file").agg(F.count("*").alias("c"))
    more = of_file.groupBy("canon").agg(F.sum("c").alias("_more"), F.max(F.least("c", F.lit(MOST_PER_FILE))).cast("int").alias("_most"))
    old = nodes.join(more, "canon", "left").withColumn("count", F.col("count") + F.coalesce("_more", F.lit(0)))
    if "max_count" in kept:
        old = old.withColumn("max_count", F.greatest("max_count", "_most"))
    return old.select("node", "canon", "count", *kept, F.lit(False).alias("is_new")).unionByName(fresh)


def zero_counts(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("count", F.lit(0).cast("long")).withColumn("max_count", F.lit(0))


def limit_counts(ws: Workspace, nodes: DataFrame, least: int, most: int = 0) -> DataFrame:
    """Nodes with least <= count <= most (0: no limit), numbered anew from 3 in their old order; old_node is kept."""
    kept = nodes.where((F.col("node") > RESERVED) & (F.col("count") >= least) & (F.lit(most == 0) | (F.col("count") <= most)))
    kept = running_total(ws, kept.withColumnRenamed("node", "old_node"), ["old_node"], name="rank")
    return kept.withColumn("node", F.col("rank") + 1 + RESERVED).drop("rank")


def index_without(ws: Workspace, index: DataFrame, gone: DataFrame) -> DataFrame:
    """An index (value, index) after removing gone (value): the others keep their numbers' order and are dense again."""
    kept = index.join(gone.select("value"), "value", "left_anti").withColumnRenamed("index", "_old")
    return running_total(ws, kept, ["_old"], name="index").select("value", "index")


def index_with(ws: Workspace, index: DataFrame, added: DataFrame) -> DataFrame:
    """An index (value, index) after adding values (value): those it lacks get the next numbers, in their own order."""
    last = index.agg(F.max("index").alias("m")).first().m
    fresh = running_total(ws, added.select("value").distinct().join(index, "value", "left_anti"), ["value"], name="index")
    return index.select("value", "index").unionByName(fresh.select("value", (F.col("index") + (-1 if last is None else last) + 1).alias("index")))


def dense_index(ws: Workspace, values: DataFrame, column: str, order: list | None = None) -> DataFrame:
    """(value, index): distinct values with dense numbers from 0, in their own order or that of their smallest ``order``."""
    if order:
        first = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(F.struct(*order)).alias("_first"))
        return running_total(ws, first, ["_first", "value"], name="index").select("value", "index")
    return running_total(ws, values.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct(), ["value"], name="index")
