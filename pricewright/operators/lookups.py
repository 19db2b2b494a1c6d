"""Latest rows, pages, get-or-create keys, cascades and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns of each key's last row by the order, nulls first. One
    aggregation with partial results on the map side; no sort, no window.
    Full ties are broken by the columns' own order. Keys may be null."""
    row = F.max(F.struct(*order, *(c for c in columns if c not in order))).alias("row")
    return df.groupBy(*keys).agg(row).select(*keys, *(F.col("row")[c].alias(c) for c in columns))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """left with the value that right gave its key last at or before `at`: both
    sides in one sorted stream per key, the value carried forward. Rows of left
    without any earlier value get null."""
    a = left.withColumns({"_at": F.col(at), "_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(F.col(key), F.col(since).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    w = Window.partitionBy(key).orderBy("_at", "_side", "_value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_side = 1").select(*left.columns, value)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """A page of rows in a total order, numbered from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_counts(df: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys, total, total_pages, last_page_size) of each key's list."""
    n = df.groupBy(*keys).agg(F.count("*").alias("total"))
    return n.withColumns({"total_pages": F.ceil(F.col("total") / size), "last_page_size": F.when(F.col("total") % size == 0, size).otherwise(F.col("total") % size)})


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark cuts each task's rows to k a key
    before they are shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def missing_rows(batch: DataFrame, known: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows of a batch whose key isn't known, once per key, the first by order:
    what a get-or-create load inserts."""
    first = Window.partitionBy(*keys).orderBy(order)
    fresh = batch.join(known.select(*keys).distinct(), list(keys), "left_anti")
    return fresh.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def without(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A child table after the parents in `gone` are deleted with what hangs on them."""
    return child.join(gone.select(key), key, "left_anti")


def set_sides(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, side): old, new or both, for every key of either side."""
    a = old.select(key).distinct().withColumn("_o", F.lit(True))
    b = new.select(key).distinct().withColumn("_n", F.lit(True))
    side = F.when(F.col("_n").isNull(), "old").when(F.col("_o").isNull(), "new").otherwise("both")
    return a.join(b, key, "full").select(key, side.alias("side"))


def envelope(df: DataFrame, order: Sequence[Column], number: int, size: int, key: str) -> DataFrame:
    """A page with its envelope: (page, total, total_pages, has_next, has_previous,
    ids), the keys of the page in order."""
    n = df.agg(F.count("*")).scalar()
    rows = page(df, order, number, size).agg(F.array_join(F.collect_list(F.col(key).cast("string")), ",").alias("ids"))
    pages = F.ceil(n / size)
    return rows.select(F.lit(number).alias("page"), n.alias("total"), pages.alias("total_pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_previous"), "ids")


def search(df: DataFrame, word: str, columns: Sequence[str], by: str, tie: str, size: int) -> DataFrame:
    """The first rows with a word in one of the columns, regardless of case, sorted
    by the number in a column, where there is none by its letters; place from 1."""
    hit = df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(word.lower())))
    number = F.regexp_replace(by, "[^0-9.]", "").try_cast("double")
    order = [number.asc_nulls_last(), F.lower(by).asc_nulls_last(), F.col(tie)]
    w = Window.orderBy(*order)
    return hit.orderBy(*order).limit(size).withColumn("place", F.row_number().over(w))
