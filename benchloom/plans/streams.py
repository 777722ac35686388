"""Queries of streams: the incremental ingest, and windows over events (these are additions to it)."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import ingest as I
from .corpus import LOST
from .registry import query, table


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see: below the cluster's checkpoint folder, or one of its own on a single machine."""
    import uuid

    at = spark.conf.get("spark.checkpoint.dir", "")
    return f"{at.rstrip('/')}/{uuid.uuid4().hex}" if at else tempfile.mkdtemp(prefix="benchloom-")


@query(
    f"""SELECT id, publication_number, CAST(y AS INT) AS year FROM (SELECT id, publication_number, y, min(y) OVER (PARTITION BY publication_number) AS first_year FROM (
      SELECT id, any_value(publication_number) AS publication_number, any_value(CASE WHEN regexp_matches(publication_date, '^(19|20)[0-9]{{2}}') THEN CAST(substr(publication_date, 1, 4) AS INT) // 5 * 5 ELSE 0 END) AS y FROM corpus WHERE id IS NOT NULL AND trim(publication_number) != '' GROUP BY id)) WHERE y = first_year OR trim(publication_number) IN ({LOST})"""
)
def incremental_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The corpus ingested as a stream, five years a batch; a publication belongs to the first batch that has it, a lost number to none."""
    root = shared_folder(spark)
    year = F.when(F.col("publication_date").rlike("^(19|20)[0-9]{2}"), F.floor(F.substring("publication_date", 1, 4).cast("int") / 5).cast("int") * 5).otherwise(0)
    rows = table(spark, d, "corpus", "id", "publication_number", "publication_date").where("id is not null and trim(publication_number) != ''")
    rows = rows.groupBy("id").agg(F.first("publication_number").alias("publication_number"), F.first(year).alias("year"))
    for y in sorted(r[0] for r in rows.select("year").distinct().collect()):  # one file a batch, as deliveries come
        rows.where(F.col("year") == y).coalesce(1).write.mode("append").parquet(f"{root}/in")
    I.ingest(spark, f"{root}/in", "id string, publication_number string, year int", f"{root}/corpus", f"{root}/manifest", f"{root}/state")
    return spark.read.parquet(f"{root}/corpus/batch=*").select("id", "publication_number", "year")


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type."""
    return I.tumbling(table(spark, d, "events", "ts", "event_type", "value"), "1 hour", "10 minutes")


@query(
    "SELECT s AS start, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 minutes, ts), time_bucket(INTERVAL 30 minutes, ts) - INTERVAL 30 minutes]) AS s FROM events) GROUP BY 1"
)
def sliding_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour, every half hour."""
    return I.sliding(table(spark, d, "events", "ts"), "1 hour", "30 minutes", "10 minutes")


@query(
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 minutes AS "end", count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"""
)
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users that end after half an hour."""
    return I.sessions(table(spark, d, "events", "user_id", "ts"), "30 minutes", "10 minutes")


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def events_once(spark: SparkSession, d: str) -> DataFrame:
    """Events once per identifier, by type."""
    return I.without_repeats(table(spark, d, "events", "event_id", "ts", "event_type"), "10 minutes").groupBy("event_type").agg(F.count("*").alias("n"))
