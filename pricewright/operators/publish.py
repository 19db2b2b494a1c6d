"""Idempotent publishing: declared tables, row validation, upsert plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewright.functions.normalize import natural_key


@dataclass(frozen=True)
class FieldRule:
    """What a field of a published table must satisfy."""

    required: bool = False
    number: bool = False
    max_length: int | None = None
    pattern: str | None = None
    low: float | None = None
    high: float | None = None
    among: tuple[str, ...] = ()


@dataclass(frozen=True)
class TableRule:
    """A published table: its natural key and the rules of its fields."""

    name: str
    key: tuple[str, ...]
    fields: dict[str, FieldRule] = field(default_factory=dict)


def violations(rule: TableRule) -> Column:
    """The rules a row breaks, as an array of field:reason."""
    out = []
    for name, r in rule.fields.items():
        c = F.col(name)
        text = c.cast("string")
        empty = F.coalesce(F.trim(text) == "", F.lit(True))
        say = lambda when, why: F.when(when, F.lit(f"{name}:{why}"))  # noqa: B023, E731
        if r.required:
            out.append(say(empty, "missing"))
        if r.number:
            out.append(say(~empty & text.try_cast("double").isNull(), "number"))
        if r.max_length:
            out.append(say(F.length(text) > r.max_length, "length"))
        if r.pattern:
            out.append(say(~empty & ~text.rlike(r.pattern), "pattern"))
        if r.low is not None:
            out.append(say(text.try_cast("double") < r.low, "low"))
        if r.high is not None:
            out.append(say(text.try_cast("double") > r.high, "high"))
        if r.among:
            out.append(say(~empty & ~text.isin(*r.among), "value"))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def validate(df: DataFrame, rule: TableRule) -> DataFrame:
    """Rows with the list of rules they break; extra columns stay."""
    return df.withColumn("violations", violations(rule))


def violation_counts(df: DataFrame, rule: TableRule) -> DataFrame:
    """(violation, n) over all rows."""
    return df.select(F.explode(violations(rule)).alias("violation")).groupBy("violation").agg(F.count("*").alias("n"))


def upsert_plan(source: DataFrame, target: DataFrame, rule: TableRule, values: list[str], order: str) -> DataFrame:
    """(key_hash, action, *values): create, update or same for each row of the
    source, by the hash of its natural key; of repeated keys in the batch the last counts."""
    def hashed(d: DataFrame) -> DataFrame:
        return d.withColumn("key_hash", natural_key(*(F.col(k) for k in rule.key)))

    row = F.max(F.struct(order, *(v for v in values if v != order))).alias("r")
    s = hashed(source).groupBy("key_hash").agg(row).select("key_hash", *(F.col("r")[v].alias(v) for v in values))
    t = hashed(target).groupBy("key_hash").agg(F.max(F.struct(*values)).alias("t"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col("t")[v])
    action = F.when(F.col("t").isNull(), "create").when(same, "same").otherwise("update")
    return s.join(t, "key_hash", "left").select("key_hash", action.alias("action"), *values)


def deliver(plan: DataFrame, send: Callable[[list[dict]], None], chunk: int = 200) -> DataFrame:
    """Send a plan's rows in chunks from the executors and count them. `send`
    gets a list of rows and must be idempotent by key_hash, as tasks are retried."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        n = chunks = 0
        for b in batches:
            rows = b.to_dict("records")
            for i in range(0, len(rows), chunk):
                send(rows[i : i + chunk])
                n, chunks = n + len(rows[i : i + chunk]), chunks + 1
        yield pd.DataFrame({"rows": [n], "chunks": [chunks]})

    return plan.where("action <> 'same'").mapInPandas(run, "rows bigint, chunks bigint").agg(F.sum("rows").alias("rows"), F.sum("chunks").alias("chunks"))
