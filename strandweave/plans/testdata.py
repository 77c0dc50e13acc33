"""The graph operators' inputs from the plain tables.

Sequences are the bases of texts, as a reader of sequence files takes them.
Categories become nodes for paths that need no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

from strandweave.functions import dna
from strandweave.operators import dictionary, pathing, selection
from strandweave.params import SampleParams
from strandweave.runtime import Workspace, running_total

#: The usual parameters, and short fragments for mapping short queries.
PARAMS, SHORT = SampleParams(), SampleParams(k=5, w=10)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Small files in one row group make one task; deal their rows out where the session has more cores than tasks."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if len(df.inputFiles()) < 2 else df


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_ord, source, len, seq) of documents, in doc_id order."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return selection.clean(docs.withColumnRenamed("doc_id", "seq_ord"))


def with_files(ws: Workspace, seqs: DataFrame, starts: bool = True) -> DataFrame:
    """(seq_ord, file, len, start): file numbers sources in their order, start is the bases before a sequence."""
    light = ws.put(seqs.select("seq_ord", "source", "len"), "lengths")
    out = light.join(file_numbers(light), F.col("source") == F.col("_s")).select("seq_ord", "file", "len")
    return running_total(ws, out, ["seq_ord"], F.col("len"), "start") if starts else out


def file_numbers(seqs: DataFrame) -> DataFrame:
    """(_s, file): sources numbered in their order."""
    return seqs.select("source").distinct().select(F.col("source").alias("_s"), F.row_number().over(Over.orderBy("source")).cast("int").alias("file"))


def conversation_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_ord, source, len, seq) of messages."""
    rows = spread(table(spark, sf_dir, "conversations")).select((F.col("conv_id") * 100000 + F.col("turn")).alias("seq_ord"), F.col("role").alias("source"), dna.clean(F.col("text")).alias("seq"))
    return rows.withColumn("len", F.length("seq").cast("long"))


def benchmark_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_ord, source, len, seq) of benchmark items."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_ord"), F.lit("benchmark").alias("source"), dna.clean(F.col("text")).alias("seq"))
    return rows.withColumn("len", F.length("seq").cast("long"))


class Indexed:
    """Documents with what most queries need of them, each made once and on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str, name: str, params: SampleParams = PARAMS):
        self.params = params
        self.spark, self.sf_dir, self.ws = spark, sf_dir, Workspace(spark, name)
        self.seqs = sequences(spark, sf_dir)
        self._made: dict = {}

    def _once(self, name, make):
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def occurrences(self) -> DataFrame:
        return self._once("occurrences", lambda: self.ws.put(selection.syncmers(self.seqs, self.params), "occurrences"))

    @property
    def files(self) -> DataFrame:
        return self._once("files", lambda: self.ws.put(with_files(self.ws, self.seqs), "files"))

    @property
    def nodes(self) -> DataFrame:
        return self._once("nodes", lambda: self.ws.put(dictionary.build(self.ws, self.occurrences, self.files), "nodes"))

    @property
    def visits(self) -> DataFrame:
        return self._once("visits", lambda: self.ws.put(pathing.visits(dictionary.look_up(self.occurrences, self.nodes)), "visits"))


def event_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as paths: the event type is the node, gaps are 1."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    order = Over.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    return rows.select(F.col("user_id").alias("path_id"), "idx", F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).cast("long").alias("node"), F.col("idx").alias("pos"))


def order_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as paths: status and priority make the node, days are the gaps."""
    order = Over.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    status = F.array_position(F.array(*[F.lit(x) for x in "FOP"]), F.col("o_orderstatus"))
    rows = table(spark, sf_dir, "orders").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    return rows.select(F.col("o_custkey").alias("path_id"), "idx", ((status - 1) * 5 + F.substring("o_orderpriority", 1, 1).cast("long")).cast("long").alias("node"), F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).cast("long").alias("pos"))


def lineitem_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as paths: the part is the node, negative where it was returned."""
    order = Over.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    return rows.select(F.col("l_orderkey").alias("path_id"), "idx", F.when(F.col("l_returnflag") == "R", -(F.col("l_partkey") + 1)).otherwise(F.col("l_partkey") + 1).alias("node"), F.col("idx").alias("pos"))
