"""Metrics refreshed while a log grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """The log's files as a stream; each is read once, as the checkpoint tells."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def reason_rates(events: DataFrame, reasons: str = "reject_reasons", decision: str = "gate_decision") -> DataFrame:
    """Rows by reason and decision, a row under each of its reasons. Keys are few, so complete mode is safe."""
    named = F.when(F.coalesce(F.size(reasons), F.lit(0)) > 0, F.col(reasons)).otherwise(F.array(F.lit("__none__")))
    return events.withColumn("reason", F.explode(named)).groupBy("reason", decision).agg(F.count("*").alias("n"))


def maintain(summary: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Overwrite ``path`` with the whole summary after every batch."""
    writer = summary.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda df, _: df.coalesce(1).write.mode("overwrite").parquet(path))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def deduplicated(events: DataFrame, id_col: str, ts: str, lateness: str = "1 hour") -> DataFrame:
    """First event of each id within the watermark."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([id_col])
