"""Structured Streaming over the event table (an extra; the analysed system has
no streams)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.sources.checkpoints import shared_folder


def event_windows(stream: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, event_type, events, total): tumbling windows that close when
    the watermark passes; rows with a null time or type are left out."""
    timed = stream.where("ts is not null and event_type is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), "event_type", "events", "total")


def run_available(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """Everything that is there now, through a stream into the shared folder.

    Output and progress live in one folder: a restarted run goes on where the last
    one stopped.  The final state is written by complete mode, since open windows
    never close in a finite input.
    """
    source = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(source).schema
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder_of(spark, source))
    out = f"{base}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = event_windows(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def _folder_of(spark: SparkSession, path: str) -> str:
    """A stream reads folders: a single file is read through a glob of its name."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getFileStatus(target).isDirectory():
        return path
    head, _, last = path.rpartition("/")
    return f"{head}/{last[0]}[{last[1]}]{last[2:]}"
