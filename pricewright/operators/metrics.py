"""Metrics, feedback and run statistics over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metric_summary(events: DataFrame, name: str, ts: str, value: str) -> DataFrame:
    """Count, sum, mean, extremes and last value of each metric."""
    v = F.col(value)
    return events.groupBy(F.col(name).alias("name")).agg(
        F.count(v).alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.round(F.min(v), 6).alias("least"), F.round(F.max(v), 6).alias("most"),
        F.round(F.max(F.when(v.isNotNull(), F.struct(ts, value)))[value], 6).alias("last"),
    )


def period_counts(events: DataFrame, ts: str, name: str, periods: tuple[str, ...] = ("day", "week", "month")) -> DataFrame:
    """(period, start, name, n): counts by day, week and month in one pass over
    the input; the coarser periods are summed from the days."""
    days = events.where(F.col(ts).isNotNull()).groupBy(F.date_trunc("day", ts).alias("day"), F.col(name).alias("name")).agg(F.count("*").alias("n"))
    stacked = days.select("name", "n", F.explode(F.array(*(F.struct(F.lit(p).alias("period"), F.date_trunc(p, "day").alias("start")) for p in periods))).alias("p"))
    return stacked.groupBy("p.period", "p.start", "name").agg(F.sum("n").alias("n"))


def rates(events: DataFrame, group: str, ok: Column) -> DataFrame:
    """(group, n, ok, rate) with totals over all groups, by rollup."""
    r = events.rollup(group).agg
    d = r(F.grouping(group).alias("is_total"), F.count("*").alias("n"), F.count_if(ok).alias("ok"))
    return d.withColumn("rate", F.round(F.col("ok") / F.col("n"), 6))


def recent(events: DataFrame, ts: str, minutes: int, until: Column | None = None) -> DataFrame:
    """Events of the last minutes before `until`, or before the last event."""
    if until is None:
        return events.where(F.col(ts) >= events.agg(F.max(ts)).scalar() - F.expr(f"INTERVAL {minutes} MINUTES"))
    return events.where((F.col(ts) >= until - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col(ts) <= until))


def keep_last(events: DataFrame, name: str, ts: str, tie: str, k: int) -> DataFrame:
    """The last k events of each metric."""
    w = Window.partitionBy(name).orderBy(F.col(ts).desc(), F.col(tie).desc())
    return events.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def sessions(events: DataFrame, user: str, ts: str, gap_minutes: int = 30) -> DataFrame:
    """(user, session_no, started, ended, events): runs without a longer gap."""
    w = Window.partitionBy(user).orderBy(ts)
    far = F.coalesce((F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w)) > gap_minutes * 60, F.lit(True))
    d = events.withColumn("_n", far.cast("int"))
    d = d.withColumn("session_no", F.sum("_n").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return d.groupBy(F.col(user).alias("user"), "session_no").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("events"))


def corrections(a: DataFrame, read: str, meant: str) -> DataFrame:
    """(read, meant, n): characters taken for others in pairs of texts."""
    from pricewright.functions.normalize import substitutions

    return a.select(F.explode(substitutions(F.col(read), F.col(meant))).alias("s")).groupBy("s.read", "s.meant").agg(F.count("*").alias("n"))


def run_statistics(runs: DataFrame, states: dict[str, str], days: int = 30) -> DataFrame:
    """One row: runs in all, by state, of the last days before the latest, success
    in percent, mean seconds of the successful, and rows processed. runs:
    (status, started_at, completed_at, rows_processed)."""
    ok = F.col("status") == states["successful"]
    seconds = F.unix_micros("completed_at") / 1e6 - F.unix_micros("started_at") / 1e6
    since = runs.agg(F.max("started_at")).scalar() - F.expr(f"INTERVAL {days} DAYS")
    d = runs.agg(
        F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(n) for n, s in states.items()), F.count_if(F.col("started_at") >= since).alias("recent"),
        F.round(F.avg(F.when(ok & (seconds > 0), seconds)), 6).alias("avg_seconds"), F.coalesce(F.sum("rows_processed"), F.lit(0)).alias("total_rows"),
    )
    return d.withColumn("success_rate", F.when(F.col("total") > 0, F.round(F.col("successful") / F.col("total") * 100, 6)).otherwise(0.0))


def sheet_statistics(df: DataFrame, sheet: str, price: str = "base_price", active: str = "is_active") -> DataFrame:
    """Rows of each sheet, mean, least and most of the prices other than zero, active and inactive rows."""
    p = F.nullif(F.col(price), F.lit(0).cast(df.schema[price].dataType))
    return df.groupBy(sheet).agg(F.count("*").alias("rows"), F.round(F.avg(p), 4).alias("mean_price"), F.min(p).alias("least"), F.max(p).alias("most"), F.count_if(active).alias("active"), F.count_if(~F.col(active)).alias("inactive"))


def health(events: DataFrame, ts: str, is_error: Column, is_request: Column, minutes: int = 5, most: float = 0.05) -> DataFrame:
    """One row on the minutes before the last event: errors, requests, their rate, and whether it is low."""
    d = recent(events, ts, minutes).agg(F.count_if(is_error).alias("errors"), F.count_if(is_request).alias("requests"))
    rate = F.when(F.col("requests") > 0, F.col("errors") / F.col("requests")).otherwise(0.0)
    return d.select("errors", "requests", F.round(rate, 6).alias("error_rate"), (rate < most).alias("healthy"))


def error_counts(counters: DataFrame) -> DataFrame:
    """(kind, value, n): counters named errors_<name> by category, and counters
    named http_status_<code> of client and server errors by code."""
    from pricewright.functions.normalize import error_category

    name = F.col("name")
    a = counters.where(name.startswith("errors_")).select(F.lit("category").alias("kind"), error_category(F.expr("substring(name, 8)")).alias("value"))
    b = counters.where(name.rlike("^http_status_[45]")).select(F.lit("status").alias("kind"), F.expr("substring(name, 13)").alias("value"))
    return a.unionByName(b).groupBy("kind", "value").agg(F.count("*").alias("n"))
