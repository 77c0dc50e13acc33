"""Exact typing: where given k-mers of up to 31 bases occur, on either strand."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import dna
from strandweave.operators.selection import _gather, _rows, numbers

#: K-mers that are taken to the tasks at once, about; bases whose k-mers a task holds at once.
BLOCK, PIECE, FLANK = 1 << 20, 1 << 21, 50


def check_list(kmers: DataFrame, k: int = 31) -> DataFrame:
    """kmers (id, kmer) in lower case with their numbers; raises for other letters, another length or a repeated k-mer."""
    rows = kmers.select("id", F.lower("kmer").alias("kmer"))
    rows = rows.withColumn("number", F.when(F.col("kmer").rlike(f"^[acgt]{{{k}}}$"), dna.kmer_number(F.col("kmer"))).otherwise(F.raise_error(F.concat(F.lit(f"not {k} bases: "), F.coalesce("kmer", F.lit("null"))))))
    rows = rows.groupBy("number", "kmer").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    return rows.select("id", "kmer", F.when(F.col("n") == 1, F.col("number")).otherwise(F.raise_error(F.concat(F.lit("given twice: "), F.col("kmer")))).alias("number"))


def matches(seqs: DataFrame, kmers: DataFrame, k: int = 31) -> DataFrame:
    """(seq_ord, pos, id, strand): every occurrence of kmers (id, kmer) in seqs (seq_ord, seq).

    pos is the first base of the k-mer's place on the forward strand; strand is -1
    where its reverse complement is there.  A longer list means more blocks of
    k-mers, each one more pass over the sequences.
    """
    spark = seqs.sparkSession
    listed = check_list(kmers, k)
    blocks, out = max(1, -(-listed.count() // BLOCK)), None
    for b in range(blocks):
        own = listed.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == b).select("number").toArrow().column("number").to_numpy()
        shared = spark.sparkContext.broadcast(np.sort(own.astype(np.uint64)))
        rows = seqs.select("seq_ord", "seq").mapInArrow(_finder(shared, k), "seq_ord long, pos long, number long, strand int")
        out = rows if out is None else out.unionByName(rows)
    return out.join(listed.select("number", "id"), "number").select("seq_ord", "pos", "id", "strand")


def _finder(shared, k: int):
    def hits(c: np.ndarray, wanted: np.ndarray):
        for strand, n in ((1, numbers(c, k)), (-1, numbers((3 - c)[::-1], k)[::-1])):
            if len(n) and len(wanted):
                at = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, n), len(wanted) - 1)] == n)
                if len(at):
                    yield at, n[at], np.full(len(at), strand)

    def found(it):
        wanted = shared.value
        for batch in it:
            for i, c in _rows(batch):
                for start in range(0, max(len(c) - k + 1, 0), PIECE):
                    for at, n, strand in hits(c[start : start + PIECE + k - 1], wanted):
                        yield i, at + start, n, strand

    def run(it):
        yield from _gather(found(it), {"pos": pa.int64(), "number": pa.int64(), "strand": pa.int32()})

    return run


def counts(found: DataFrame, seqs: DataFrame) -> DataFrame:
    """(file, id, count) of matches; seqs has (seq_ord, file)."""
    return found.join(seqs.select("seq_ord", "file"), "seq_ord").groupBy("file", "id").agg(F.count("*").alias("count"))


def table(counted: DataFrame, ids: list[str]) -> DataFrame:
    """One row for each file with a column for each k-mer."""
    return counted.groupBy("file").pivot("id", ids).agg(F.sum("count")).na.fill(0, ids)


def windows(seqs: DataFrame, k: int = 31) -> DataFrame:
    """(file, windows): k-mers looked at in each file."""
    return seqs.groupBy("file").agg(F.sum(F.greatest(F.lit(0), F.length("seq") - k + 1)).cast("long").alias("windows"))


def contexts(found: DataFrame, seqs: DataFrame, k: int = 31, flank: int = FLANK) -> DataFrame:
    """matches with their context: ``flank`` bases on both sides in the k-mer's direction, dots beyond the ends."""
    rows = found.join(seqs.select("seq_ord", "seq"), "seq_ord")
    left = F.lpad(F.expr(f"substring(seq, greatest(cast(pos AS int) - {flank}, 0) + 1, least(cast(pos AS int), {flank}))"), flank, ".")
    right = F.rpad(F.expr(f"substring(seq, cast(pos AS int) + {k + 1}, {flank})"), flank, ".")
    whole = F.concat(left, F.upper(F.expr(f"substring(seq, cast(pos AS int) + 1, {k})")), right)
    back = F.reverse(F.translate(whole, "acgtACGT", "tgcaTGCA"))
    return rows.select("seq_ord", "pos", "id", "strand", F.when(F.col("strand") > 0, whole).otherwise(back).alias("context"))
