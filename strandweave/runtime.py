"""What all operators share: the shared folder for cut lineage, membership filters, connected components.

Everything an operator stores between steps goes to the folder that the cluster
names in ``spark.checkpoint.dir``.  Only a local session without that setting
gets a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

#: Bits of a membership filter: 2**24 bits are at most 2**18 rows of 16 bytes, whatever they were made from.
FILTER_BITS = 24
#: Rows of an Arrow batch.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, as a URI or path without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='strandweave-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of fewer rows than Spark's default unless the session has a number: rows here hold whole texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Workspace:
    """A folder of one run's intermediate tables below the shared folder.

    ``put`` cuts lineage: it writes a DataFrame as Parquet and reads it back, so
    a lost executor costs a re-read and not a recomputation.  Tables that a lazy
    result still reads must stay; ``drop`` removes those that nothing needs.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.path = f"{shared_dir(spark)}/strandweave/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def at(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.at(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def clear(self) -> None:
        """Delete all tables; nothing may read them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._stored_at)
            path.getFileSystem(conf).delete(path, True)


def _slot(key, bits: int):
    return F.xxhash64(key).bitwiseAND(F.lit((1 << bits) - 1))


def membership(ids: DataFrame, column: str, bits: int = FILTER_BITS) -> DataFrame:
    """A one-hash Bloom filter of a column as rows (word, mask); at most 2**(bits-6) rows, so it may be broadcast."""
    slots = ids.select(_slot(F.col(column), bits).alias("_slot"))
    return slots.selectExpr("shiftright(_slot, 6) AS _word", "shiftleft(1L, cast(_slot & 63 AS int)) AS _bit").groupBy("_word").agg(F.bit_or("_bit").alias("_mask"))


def fresh(columns, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it apart from columns; case does not count."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame) -> list:
    """All columns of df by name, whatever characters the names hold."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def maybe_in(df: DataFrame, key, members: DataFrame, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be a member, rows whose key certainly is none), with df's columns. Adds no shuffle of df."""
    word, mask = fresh(df.columns, "_word", "_mask")
    words = F.broadcast(members.withColumnsRenamed({"_word": word, "_mask": mask}))
    slot = _slot(key, bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    joined = df.join(words, F.shiftright(slot, 6) == F.col(word), "left")
    there = F.coalesce(F.col(mask).bitwiseAND(bit) != 0, F.lit(False))
    return joined.where(there).select(*columns_of(df)), joined.where(~there).select(*columns_of(df))


def connected_components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as rows (a, b) of longs; component is the smallest node reachable.

    Large-star and small-star rounds, each a join of the edges with each node's
    smallest neighbour, until every node points at one that points at no other;
    every round is written to the shared folder.  Nodes without an edge are not
    returned.
    """
    now = ws.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        ends = F.explode(F.array(F.struct(F.col("u").alias("n"), "v"), F.struct(F.col("v").alias("n"), "v")))
        if now.select(ends.alias("e")).groupBy("e.n").agg((F.min("e.v") < F.max("e.v")).alias("open")).where("open").isEmpty():
            break
        # The least neighbours are written first: so adaptive execution can split a node of very many edges in either join.
        both = now.union(now.select("v", "u"))
        low = ws.put(both.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        lower = ws.put(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        following = ws.put(small, "edges")
        ws.drop(now, low, lower)
        now = following
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def running_total(ws: Workspace, df: DataFrame, order: list, value=None, name: str = "before") -> DataFrame:
    """df with the total of ``value`` (default: a count) over all rows before each one in a global order.

    Rows are range-partitioned and each partition is summed by itself; only a sum
    for each partition meets in one place.  ``order`` must tell all rows apart.
    """
    value = F.lit(1) if value is None else value
    dealt = df.withColumn("_value", value.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = ws.put(dealt.withColumn("_part", F.shiftright("_at", 33).cast("int")), "ordered")
    inside = Over.partitionBy("_part").orderBy("_at").rowsBetween(Over.unboundedPreceding, -1)
    sums = dealt.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    base = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(Over.orderBy("_part").rowsBetween(Over.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    out = dealt.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(base, F.col("_part") == F.col("_p"))
    return out.withColumn(name, (F.col("_inside") + F.col("_base")).cast("long")).drop("_value", "_at", "_part", "_p", "_base", "_inside")
