"""A folder in which documents arrive, analysed batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import corpus as C


def watch_documents(spark: SparkSession, folder: str) -> DataFrame:
    """docs of the Markdown files that arrive, as a stream."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "")
    return C.documents_of(files.select(F.col("_metadata.file_path").alias("path"), stem.alias("stem"), F.col("value").alias("raw")))


def analyse(docs: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes work(batch) to out as Parquet, one folder a batch, so that a batch that
    is run again replaces its own output."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_windows(events: DataFrame, late: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type in tumbling windows, late rows dropped behind
    the watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
