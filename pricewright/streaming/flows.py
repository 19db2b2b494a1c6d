"""Streams over landing folders: windowed metrics and idempotent upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.runtime import finished, forget, shared_dir


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    """A stream of the files that land under a path."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def windowed(stream: DataFrame, ts: str, name: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and name, with a watermark for late rows."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = stream.withWatermark(ts, late).groupBy(w.alias("w"), F.col(name).alias("name"))
    return g.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "name", "n", "total")


def sessions(stream: DataFrame, ts: str, user: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Events per user and session."""
    g = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), F.col(user).alias("user"))
    return g.agg(F.count("*").alias("events")).select("user", F.col("w.start").alias("started"), F.col("w.end").alias("until"), "events")


def _run(out: DataFrame, mode: str, keep) -> None:  # noqa: ANN001
    q = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{shared_dir(out.sparkSession).rstrip('/')}/state-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def run_updates(out: DataFrame, keys: list[str]) -> DataFrame:
    """Run a stream of aggregates over what has landed and return each key's last
    row. A batch writes only the rows it changed, under its own number, so that
    a batch that is run again replaces itself; the watermark lets old state go."""
    spark = out.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/updates-{uuid.uuid4().hex}"
    spark.createDataFrame([], out.schema).write.parquet(f"{base}/batch=-1")
    _run(out, "update", lambda df, n: df.write.mode("overwrite").parquet(f"{base}/batch={n}"))
    rest = [c for c in out.columns if c not in keys]
    rows = spark.read.parquet(base)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*(F.col("r")[c].alias(c) if c in rest else F.col(c) for c in out.columns))


def run_complete(out: DataFrame) -> DataFrame:
    """The same for aggregates that have no update mode (sessions), over a
    backlog that ends: every batch writes the whole result under its number and
    the last one counts. State is kept until the run is over."""
    spark = out.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"

    def keep(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{base}/result/v{n}")
        forget(spark, f"{base}/result/v{n - 2}")

    _run(out, "complete", keep)
    done = finished(spark, base, "result")
    return spark.read.parquet(f"{base}/result/v{done[-1]}") if done else spark.createDataFrame([], out.schema)


def upsert_stream(stream: DataFrame, target: str, key: str, order: str, checkpoint: str):
    """Keep a table with each key's last row as versions target/table/vN, N the
    batch. The current version is the highest complete one (see current); no
    pointer can be lost, a failure to read it ends the batch, and a batch that
    is run again does no harm. The version before is kept for its readers,
    older ones are removed."""
    spark = stream.sparkSession

    def merge(batch: DataFrame, n: int) -> None:
        done = finished(spark, target, "table")
        if done and done[-1] >= n:
            return
        both = spark.read.parquet(f"{target}/table/v{done[-1]}").unionByName(batch) if done else batch
        row = F.max(F.struct(F.col(order).alias("_o"), *both.columns)).alias("r")
        both.groupBy(F.col(key).alias("_k")).agg(row).select(*(F.col("r")[c].alias(c) for c in both.columns)).write.mode("overwrite").parquet(f"{target}/table/v{n}")
        for old in done[:-1]:
            forget(spark, f"{target}/table/v{old}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, target: str) -> DataFrame:
    """The table an upsert stream keeps, as of its last complete batch."""
    return spark.read.parquet(f"{target}/table/v{finished(spark, target, 'table')[-1]}")
