"""File streams and the live rollup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.activity import live_rollup


def stream_files(spark: SparkSession, root: str, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every file that has not been seen to ``handle`` in batches and return when none is left."""
    lines = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(root)
    query = lines.select(F.col("_metadata.file_path").alias("file_path"), "value").writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_rollup(spark: SparkSession, path: str, target: str, checkpoint: str | None = None) -> DataFrame:
    """The minute rollup of a folder of events as a stream that ends with its input, written to ``target`` by each batch."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).format("parquet").load(path)
    live = live_rollup(events.withColumn("ts", F.col("ts").cast("timestamp")))
    writer = live.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).outputMode("complete").trigger(availableNow=True)
    writer.option("checkpointLocation", checkpoint or f"{target}-state").start().awaitTermination()
    return spark.read.schema(live.schema).parquet(target)
