"""Sequences as a stream of Parquet files (beyond the batch operators).

Selection is stateless, counts are a streaming aggregation, and a dictionary
grows batch by batch as in the batch operator: look up, then add.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.operators import selection
from strandweave.params import SampleParams


def sequences(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of (seq_ord, seq)."""
    reader = spark.readStream.schema("seq_ord long, seq string")
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def fragment_counts(stream: DataFrame, p: SampleParams) -> DataFrame:
    """(canon, count) in update or complete mode."""
    return selection.syncmers(stream, p).where("NOT poly").groupBy("canon").agg(F.count("*").alias("count"))


def event_rates(events: DataFrame, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(window, event_type, n) of a stream of events (ts, event_type); late events beyond the delay are left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def grow_dictionary(stream: DataFrame, p: SampleParams, path: str, checkpoint: str):
    """A query that appends every batch's new fragments (canon, batch) to the Parquet folder at path.

    A batch that is run again finds its own fragments there under its number and
    leaves them out of what it looks up, so it adds them once.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = selection.syncmers(batch, p).where("NOT poly").select("canon").distinct()
        target = f"{path}/batch={number}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            known = spark.read.schema("canon binary, batch long").option("basePath", path).parquet(path).where(F.col("batch") < number)
            fresh = fresh.join(known.select("canon"), "canon", "left_anti")
        fresh.write.mode("overwrite").parquet(target)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
