"""Sequences as paths of signed nodes, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from strandweave.functions import dna
from strandweave.params import SampleParams

#: Bases that are put together in one row.
STRETCH = 1 << 20


def visits(found: DataFrame) -> DataFrame:
    """(path_id, idx, node, pos) of occurrences with signed nodes (seq_ord, pos, node)."""
    order = Over.partitionBy("seq_ord").orderBy("pos")
    return found.select(F.col("seq_ord").alias("path_id"), (F.row_number().over(order) - 1).cast("long").alias("idx"), "node", "pos")


def paths(seqs: DataFrame, visited: DataFrame) -> DataFrame:
    """(path_id, file, seq_in_file, len, n_sync, nodes, pos) with a row for each sequence, also for those without nodes."""
    lists = visited.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("idx", "node", "pos"))).alias("v"))
    out = seqs.join(lists, F.col("seq_ord") == F.col("path_id"), "left")
    return out.select(
        F.col("seq_ord").alias("path_id"), "file", "seq_in_file", "len", F.coalesce(F.size("v"), F.lit(0)).cast("long").alias("n_sync"),
        F.coalesce("v.node", F.array().cast("array<bigint>")).alias("nodes"), F.coalesce("v.pos", F.array().cast("array<bigint>")).alias("pos"),
    )


def ends(seqs: DataFrame, visited: DataFrame, p: SampleParams) -> DataFrame:
    """(path_id, prefix, suffix): the bases before the first and behind the last node; without nodes, two halves."""
    span = visited.groupBy("path_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    out = seqs.select("seq_ord", "seq").join(span, F.col("seq_ord") == F.col("path_id"), "left").drop("path_id")
    none, half, n = F.col("first").isNull(), F.floor(F.length("seq") / 2).cast("int"), F.length("seq")
    prefix = F.substring("seq", F.lit(1), F.when(none, half).otherwise(F.col("first").cast("int")))
    start = F.when(none, half).otherwise((F.col("last") + p.length).cast("int"))
    return out.select(F.col("seq_ord").alias("path_id"), prefix.alias("prefix"), F.substring("seq", start + 1, n - start).alias("suffix"))


def reversed_visits(visited: DataFrame, p: SampleParams, lengths: DataFrame | None = None) -> DataFrame:
    """Each path walked backwards: nodes negated, the same gaps, idx from the other end.

    Positions are the reverse strand's if lengths (path_id, len) are given, else
    distances from the last node.
    """
    if lengths is None:
        lengths = visited.groupBy("path_id").agg((F.max("pos") + p.length).alias("len"))
    n = visited.groupBy("path_id").agg(F.count("*").alias("n"))
    both = n.join(lengths.select("path_id", "len"), "path_id")
    return visited.join(both, "path_id").select("path_id", (F.col("n") - 1 - F.col("idx")).alias("idx"), (-F.col("node")).alias("node"), (F.col("len") - p.length - F.col("pos")).alias("pos"))


def both_strands(visited: DataFrame) -> DataFrame:
    """(path_id, strand, idx, node, adj, gap): every path and its reverse; adj is the node before and gap its distance, both 0 for the first."""
    order = Over.partitionBy("path_id").orderBy("idx")
    before, after = (F.coalesce(f("node").over(order), F.lit(0)).cast("long") for f in (F.lag, F.lead))
    rows = visited.select("path_id", "idx", "node", before.alias("before"), (-after).alias("after"), F.coalesce(F.col("pos") - F.lag("pos").over(order), F.lit(0)).alias("gap"), F.coalesce(F.lead("pos").over(order) - F.col("pos"), F.lit(0)).alias("next_gap"), F.count("*").over(Over.partitionBy("path_id")).alias("n"))
    there = F.struct(F.lit(1).alias("strand"), "idx", "node", F.col("before").alias("adj"), "gap")
    back = F.struct(F.lit(-1).alias("strand"), (F.col("n") - 1 - F.col("idx")).alias("idx"), (-F.col("node")).alias("node"), F.col("after").alias("adj"), F.col("next_gap").alias("gap"))
    return rows.select("path_id", F.explode(F.array(there, back)).alias("v")).select("path_id", "v.*")


def pieces(visited: DataFrame, nodes: DataFrame, ends_: DataFrame, p: SampleParams) -> DataFrame:
    """(path_id, at, text): what each step of a path adds to its sequence, and the ends; at is the text's first base.

    A step's text goes up to where the next one's begins, so pieces neither
    overlap nor leave a gap; where homopolymer nodes were left out the last base is
    repeated.  Joins and windows only: no path is ever in one row.
    """
    text = node_text(nodes, p)
    along = Over.partitionBy("path_id").orderBy("pos")
    steps = visited.select("path_id", "node", "pos", F.lead("pos").over(along).alias("next"))
    steps = steps.join(text, F.abs("node") == F.col("_n"))
    whole = F.when(F.col("node") < 0, dna.reverse_complement(F.col("_text"))).otherwise(F.col("_text"))
    wanted = F.coalesce(F.col("next") - F.col("pos"), F.lit(p.length)).cast("int")
    filled = F.when(wanted <= p.length, F.substring(whole, F.lit(1), wanted)).otherwise(F.concat(whole, F.repeat(F.substring(whole, -1, 1), wanted - p.length)))
    middle = steps.select("path_id", F.col("pos").cast("long").alias("at"), filled.alias("text"))
    last = visited.groupBy("path_id").agg((F.max("pos") + p.length).alias("end"))
    tail = ends_.join(last, "path_id", "left").select("path_id", F.coalesce(F.col("end"), F.length("prefix")).cast("long").alias("at"), F.col("suffix").alias("text"))
    head = ends_.select("path_id", F.lit(0).cast("long").alias("at"), F.col("prefix").alias("text"))
    return middle.unionByName(head.where("text <> ''")).unionByName(tail.where("text <> ''"))


def node_text(nodes: DataFrame, p: SampleParams) -> DataFrame:
    """(_n, _text) of each node."""
    return nodes.select(F.col("node").alias("_n"), dna.unpacked(F.col("canon"), p.length).alias("_text"))


def stretches(visited: DataFrame, nodes: DataFrame, ends_: DataFrame, p: SampleParams, width: int = STRETCH) -> DataFrame:
    """(path_id, stretch, at, seq): sequences in stretches of about ``width`` bases, one row each, however long the path."""
    held = pieces(visited, nodes, ends_, p).withColumn("stretch", F.floor(F.col("at") / width))
    lists = held.groupBy("path_id", "stretch").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("x"))
    return lists.select("path_id", "stretch", F.col("x")[0]["at"].alias("at"), F.array_join(F.col("x.text"), "").alias("seq"))


def rebuild(visited: DataFrame, nodes: DataFrame, ends_: DataFrame, p: SampleParams) -> DataFrame:
    """(path_id, seq): the sequences that paths with their ends stand for; ``stretches`` gives those too long for one row."""
    parts = stretches(visited, nodes, ends_, p).groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("stretch", "seq"))).alias("x"))
    return ends_.select("path_id").join(parts, "path_id", "left").select("path_id", F.coalesce(F.array_join(F.col("x.seq"), ""), F.lit("")).alias("seq"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, as often as that; none if they agree."""
    return a.exceptAll(b).withColumn("only_in", F.lit("first")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second")))


def check_paths(seqs: DataFrame, visited: DataFrame, ends_: DataFrame, p: SampleParams) -> DataFrame:
    """(path_id, ok): whether the ends' lengths fit the first and last node and the path's length."""
    span = visited.groupBy("path_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    out = ends_.join(span, "path_id", "left").join(seqs.select(F.col("seq_ord").alias("path_id"), "len"), "path_id")
    fits = (F.length("prefix") == F.col("first")) & (F.length("suffix") == F.col("len") - F.col("last") - p.length)
    return out.select("path_id", F.when(F.col("first").isNull(), F.length("prefix") + F.length("suffix") == F.col("len")).otherwise(fits).alias("ok"))


def reverse_complemented(seqs: DataFrame) -> DataFrame:
    return seqs.withColumn("seq", dna.reverse_complement(F.col("seq")))
