"""Incremental ingest and event-time windows as structured streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import anti_committed


def append_batch(batch: DataFrame, batch_id: int, corpus: str, manifest: str) -> int:
    """Write the rows of publications that no earlier batch has written, then the manifest row; returns the rows written.

    Each batch has its own folder, overwritten when the batch is tried again after a crash, so nothing
    is written twice. A publication seen earlier stays as it is, even for a new language.
    """
    spark = batch.sparkSession
    rows = batch.dropDuplicates(["id"])
    try:
        before = spark.read.parquet(f"{corpus}/batch=*").where(F.input_file_name().rlike(r"batch=(\d+)") & (F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("long") < batch_id))
        rows = anti_committed(rows, before.select("publication_number"))
    except Exception as e:  # nothing is written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("overwrite").parquet(f"{corpus}/batch={batch_id}")
    n = spark.read.parquet(f"{corpus}/batch={batch_id}").count()
    spark.createDataFrame([(batch_id, n)], "batch_id bigint, rows_appended bigint").write.mode("overwrite").parquet(f"{manifest}/batch={batch_id}")
    return n


def ingest(spark: SparkSession, source: str, schema: str, corpus: str, manifest: str, checkpoint: str, files_per_batch: int = 1, newest_first: bool = False) -> None:
    """Read new files of a folder batch by batch until all are done; a failing batch ends the query."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("latestFirst", newest_first).parquet(source)
    q = stream.writeStream.foreachBatch(lambda df, i: append_batch(df, i, corpus, manifest) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def tumbling(events: DataFrame, size: str, lateness: str) -> DataFrame:
    """(start, event_type, n, total): counts and sums by window and type; batch and stream alike."""
    w = events.withWatermark("ts", lateness).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, lateness: str) -> DataFrame:
    """(start, n) by sliding window."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, lateness: str) -> DataFrame:
    """(user_id, start, end, n) of sessions that end after a gap."""
    return events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def without_repeats(events: DataFrame, lateness: str) -> DataFrame:
    """Events once per identifier, remembered as long as they may come again."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
