"""Queries that run as streams over the landed events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.runtime import table
from pricewright.streaming import flows


def _events(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    # A file source lists folders; the table's name is the filter in its folder.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events per hour and kind."""
    out = flows.run_updates(flows.windowed(_events(spark, d), "ts", "event_type", "value"), ["start", "end", "name"])
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Events per user and session of half an hour."""
    out = flows.run_complete(flows.sessions(_events(spark, d), "ts", "user_id"))
    return out.withColumns({"started": F.col("started").cast("timestamp_ntz"), "until": F.col("until").cast("timestamp_ntz")})


QUERIES = {f.__name__: f for f in (stream_windows, stream_sessions)}
ORACLE = {
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS \"end\", event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sessions": """WITH f AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events), n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT user_id AS user, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS until, count(*) AS events FROM n GROUP BY user_id, k""",
}
